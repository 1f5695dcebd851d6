"""Is a text one JSON document, and does a document have a declared shape? Both as column expressions over VARIANT."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

from goldrec.functions.rows import made_once

#: What stands for NaN and the infinities, which have no JSON form: a number beyond every bound.
BEYOND = 10**400


def _canonical_text(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text, parse_constant=lambda _: BEYOND), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical_text, na_action="ignore")


def one_document(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with the text of `column` kept where it is exactly one JSON document, else null.

    A VARIANT parser stops after the first value, so a text must parse as all but the last item of a list that ends with the
    text's own digest: whatever closes the list early leaves the digest out, and a second value comes before it. What fails
    is tried once more in Python, which takes repeated keys (the last wins), NaN and infinities; Python is handed null for
    all other rows.
    """
    text = F.col(f"`{column}`")
    one = F.expr(f"""try_variant_get(try_parse_json(concat('[', `{column}`, ',"', md5(`{column}`), '"]')), '$[1]', 'string') = md5(`{column}`)""")
    # Made once, the text and what it is: many expressions read them.
    marked = made_once(made_once(rows, {column: text}), {"_one": F.coalesce(one, F.lit(False))})
    return marked.withColumn(column, F.coalesce(F.when(F.col("_one"), text), _canonical(F.when(~F.col("_one"), text)))).drop("_one")


#: Type -> (kinds of VARIANT that may stand for it, what to say of others).
PLAIN = {
    StringType: ("STRING", "is not a text"), DoubleType: ("BIGINT|DOUBLE|DECIMAL", "is not a number"), LongType: ("BIGINT", "is not a whole number"), IntegerType: ("BIGINT", "is not a whole number"),
    BooleanType: ("BOOLEAN", "is not true or false"), DateType: ("STRING", "is not a date"), TimestampType: ("STRING", "is not a time"),
}
DATE = r"^\\d{4}-\\d{2}-\\d{2}(T00:00:00(Z|\\+00:00)?)?$"


def shape_faults(value: str, kind: DataType, path: str = "", closed: bool = True) -> Column:
    """Faults of a VARIANT (a SQL expression) against a type, each as `path: what is wrong`, in the order of the type.

    Nulls and missing values are none; a null item of a list is. closed: keys that the type hasn't are faults, at every
    depth. Items are named by their place (experiences[2].company), keys of maps by themselves.
    """
    return F.expr(_faults(value, kind, f"'{path}'", closed, 0))


def void(value: str) -> str:
    """Is a VARIANT missing or null? (schema_of_variant works out the type of all that a value holds.)"""
    return f"({value} IS NULL OR is_variant_null({value}))"


def _faults(value: str, kind: DataType, path: str, closed: bool, depth: int) -> str:
    none = "CAST(array() AS array<string>)"
    said = lambda what: f"array(concat({path}, ': {what}'))"
    a, x, i, k = f"a{depth}", f"x{depth}", f"i{depth}", f"k{depth}"

    def held(container: str, what: str, inner: str) -> str:
        """Faults inside what a value holds, which is taken out of it once (a), or that it is none of the container."""
        return f"CASE WHEN {void(value)} THEN {none} ELSE flatten(transform(array(try_variant_get({value}, '$', '{container}')), {a} -> CASE WHEN {a} IS NULL THEN {said(what)} ELSE {inner} END)) END"

    if isinstance(kind, StructType):
        under = lambda name: f"concat({path}, '{name}')" if path == "''" else f"concat({path}, '.{name}')"
        parts = [f"flatten(transform(array(try_element_at({a}, '{f.name}')), {x} -> {_faults(x, f.dataType, under(f.name), closed, depth + 1)}))" for f in kind.fields]
        if closed:
            names = ", ".join(f"'{f.name}'" for f in kind.fields)
            dot = f"CASE WHEN {path} = '' THEN '' ELSE concat({path}, '.') END"
            parts.insert(0, f"transform(array_except(map_keys({a}), array({names})), {k} -> concat({dot}, {k}, ': is unknown'))")
        return held("map<string,variant>", "is not an object", f"concat({', '.join(parts)})")
    if isinstance(kind, ArrayType):
        place = f"concat({path}, '[', {i}, ']')"
        each = f"transform({a}, ({x}, {i}) -> CASE WHEN {void(x)} THEN array(concat({place}, ': is null')) ELSE {_faults(x, kind.elementType, place, closed, depth + 1)} END)"
        return held("array<variant>", "is not a list", f"flatten({each})")
    if isinstance(kind, MapType):
        place = f"concat({path}, '.', {x}.key)"
        each = f"transform(map_entries({a}), {x} -> {_faults(f'{x}.value', kind.valueType, place, closed, depth + 1)})"
        return held("map<string,variant>", "is not an object", f"flatten({each})")
    found = f"coalesce(schema_of_variant({value}), 'VOID')"
    kinds, what = PLAIN[type(kind)]
    bad = f"NOT {found} RLIKE '^({kinds})'"
    if isinstance(kind, DateType):
        bad += f" OR NOT coalesce(try_variant_get({value}, '$', 'string') RLIKE '{DATE}', false) OR try_to_date(substring(try_variant_get({value}, '$', 'string'), 1, 10), 'yyyy-MM-dd') IS NULL"
    elif isinstance(kind, TimestampType):
        bad += f" OR try_to_timestamp(try_variant_get({value}, '$', 'string')) IS NULL"
    return f"CASE WHEN {found} = 'VOID' THEN {none} WHEN {bad} THEN {said(what)} ELSE {none} END"

