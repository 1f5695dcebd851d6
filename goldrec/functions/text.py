"""Text expressions over columns: stripping, casing, deduplication, keys."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: All that counts as white space, inside a character class.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same as characters.
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space as a pattern; plain characters, of which nearly all text is, are passed over by one test of their range.
WHITE = rf"(?![!-~])[{SPACE}]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, " ")


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pc.utf8_normalize(values, form="NFKC")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; Spark has no function for it, so this alone runs in Python, over Arrow."""
    return _nfkc(c)


def _composed(values: pa.Array) -> pa.Array:
    """NFKC of all texts in an Arrow array, at any depth."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.utf8_normalize(values, form="NFKC")
    if pa.types.is_struct(kind):
        values = pa.concat_arrays([values])  # a slice's fields would be those of the whole
        return pa.StructArray.from_arrays([_composed(values.field(i)) for i in range(kind.num_fields)], fields=list(kind), mask=values.is_null())
    if pa.types.is_list(kind):
        values = pa.concat_arrays([values])
        return pa.ListArray.from_arrays(values.offsets, _composed(values.values), type=kind, mask=values.is_null())
    return values


def nfkc_within(c: Column, shape: StructType) -> Column:
    """nfkc of all texts of a struct column of this type."""

    @F.arrow_udf(shape)
    def within(values: pa.Array) -> pa.Array:
        return _composed(values)

    return within(c)


def clean(c: Column) -> Column:
    """Stripped and white space collapsed; compose with nfkc first where text may hold more than ASCII."""
    return collapse(strip(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Words, split at white space and hyphens, get one leading capital if they are all upper or all lower case."""
    parts = F.regexp_extract_all(c, F.lit(rf"[^{SPACE}\-]+|[{SPACE}\-]+"), F.lit(0))
    cased = lambda x: F.when((x == F.upper(x)) | (x == F.lower(x)), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))).otherwise(x)
    return F.array_join(F.transform(parts, cased), "")


def normal_email(c: Column) -> Column:
    return F.lower(strip(c))


def key_norm(c: Column) -> Column:
    """A text as part of an identity: lower case, punctuation as spaces, white space collapsed."""
    return strip(collapse(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), rf"[^\p{{L}}\p{{N}}_{SPACE}]", " ")))


def identity_key(*cols: Column) -> Column:
    """The identity of an item; dates count by their ISO form."""
    return F.concat_ws("\x1f", *(key_norm(c.cast("string")) for c in cols))


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once: what a lambda repeats for every item should be bound before it. A fold over
    nothing: an item taken out of a transformed array would have its type worked out anew for every row."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, use)


def first_by(items: Column, key) -> Column:
    """Items of an array whose key has not come before; items with an empty key go. Order is kept."""
    kept = lambda of, keys: F.filter(of, lambda x, i: (F.array_position(keys, F.get(keys, i)) == i + 1) & (F.get(keys, i) != ""))
    return bind(items, lambda of: bind(F.transform(of, key), lambda keys: kept(of, keys)))


def dedup_ci(items: Column) -> Column:
    return first_by(items, lambda x: F.lower(strip(x)))


def dedup_exact(items: Column) -> Column:
    """Stripped strings, blanks dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def normal_skill(c: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(clean(c))), clean(c))


def normal_skills(items: Column, aliases: dict[str, str]) -> Column:
    return dedup_ci(F.filter(F.transform(items, lambda x: normal_skill(x, aliases)), lambda x: x != ""))


def normal_url(c: Column) -> Column:
    """An http(s) address with scheme and host in lower case and a path; null for anything else."""
    shape = r"^(?i)(https?)://([^\s/?#]+)([^\s]*)$"
    rest = F.regexp_extract(c, shape, 3)
    whole = F.concat(F.lower(F.regexp_extract(c, shape, 1)), F.lit("://"), F.lower(F.regexp_extract(c, shape, 2)), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(c.rlike(shape), whole)
