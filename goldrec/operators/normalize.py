"""Whole-record normalization in one pass over the rows; applying it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from goldrec.functions.phones import normal_phone
from goldrec.functions.session import once_per_session
from goldrec.functions.text import clean, nfkc, nfkc_within, normal_email, normal_skills, title_case
from goldrec.plans.config import Config

#: What plain ASCII text can't need.
WIDE = r"[^\x00-\x7F]"
#: The columns whose texts are composed, at any depth, and the texts of list items that are cleaned.
TEXTS = ("first_name", "last_name", "skills", "languages", "experiences", "education", "certifications")
PARTS = {"experiences": ("company", "title", "description"), "education": ("institution", "degree", "field_of_study"), "certifications": ("name", "issuer")}


def compose(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """NFKC of text columns. Python is handed null for a text of plain ASCII."""
    wide = lambda c: F.when(F.col(c).rlike(WIDE), F.col(c))
    return records.withColumns({c: F.coalesce(nfkc(wide(c)), F.col(c)) for c in columns})


def normalize(records: DataFrame, config: Config | None = None) -> DataFrame:
    """Every text composed (NFKC), stripped and its white space collapsed; names in title case, skills by their aliases
    and without repeats, addresses in lower case, phones in E.164. Null texts and lists stay null.

    Python sees only the records that hold something outside ASCII, each once.
    """
    config = config or Config()
    texts = F.struct(*TEXTS, F.col("contact.location").alias("location"))
    shape = records.select(texts.alias("t")).schema["t"].dataType
    held = records.withColumn("_texts", texts).withColumn("_wide", F.coalesce(F.col("_texts").cast("string").rlike(WIDE), F.lit(False)))
    # A plain record is handed over with empty texts and lists: where lists are null, the size of a batch so far, which Spark
    # asks for after each row, is told by going over all of its rows.
    plain = F.struct(*((F.array() if isinstance(f.dataType, ArrayType) else F.lit("")).cast(f.dataType).alias(f.name) for f in shape))
    composed = nfkc_within(F.when(F.col("_wide"), F.col("_texts")).otherwise(plain), shape)
    held = held.withColumn("_texts", F.when(F.col("_wide"), composed).otherwise(F.col("_texts")))
    fields = tuple((n, tuple(f.name for f in records.schema[n].dataType.elementType.fields)) for n in PARTS)
    return held.withColumns(_normal(fields, config.region, tuple(config.aliases.items()))).drop("_texts", "_wide")


@once_per_session
def _normal(fields: tuple[tuple[str, tuple[str, ...]], ...], region: str, aliases: tuple[tuple[str, str], ...]) -> dict[str, Column]:
    """The normalized columns of a record whose composed texts are in `_texts`; fields: those of the lists' items."""
    own = lambda name: F.col(f"_texts.{name}")
    table = dict(aliases)

    def rebuilt(name: str, parts: tuple[str, ...]) -> Column:
        def item(x: Column) -> Column:
            value = lambda f: clean(x[f]) if f in PARTS[name] else normal_skills(x[f], table) if f == "skills" else x[f]
            return F.struct(*(value(f).alias(f) for f in parts))

        return F.transform(own(name), item)

    contact = F.struct(
        normal_email(F.col("contact.email")).alias("email"), normal_phone(F.col("contact.phone"), region).alias("phone"), clean(own("location")).alias("location"),
        F.col("contact.linkedin_url").alias("linkedin_url"), F.col("contact.github_url").alias("github_url"),
    )
    return {
        "first_name": title_case(clean(own("first_name"))), "last_name": title_case(clean(own("last_name"))), "contact": F.when(F.col("contact").isNotNull(), contact),
        "skills": normal_skills(own("skills"), table), "languages": F.transform(own("languages"), clean), **{name: rebuilt(name, parts) for name, parts in fields},
    }
