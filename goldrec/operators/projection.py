"""Output shapes of a golden record."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from goldrec.functions.text import strip


class ProjectionError(ValueError):
    pass


def canonical(records: DataFrame) -> DataFrame:
    """Every field of the record, nulls kept; provenance as a map from the field."""
    if "provenance" in records.columns:
        given = F.transform(F.array_compact("provenance"), lambda p: F.struct(p.field.alias("key"), F.struct(p.source.alias("source"), p.raw_value.alias("raw_value"), p.extracted_at.alias("extracted_at")).alias("value")))
        records = records.withColumn("provenance", F.map_from_entries(given))
    wanted = ("entity_key", "id", "first_name", "last_name", "external_id", "contact", "experiences", "education", "skills", "certifications", "languages", "confidence", "provenance", "schema_version")
    return records.select(*(c for c in wanted if c in records.columns))


def place(c: Column) -> Column:
    """City, region, country from a comma-separated place; what is missing is an empty text."""
    part = lambda i: F.coalesce(strip(F.get(F.split(c, ","), F.lit(i))), F.lit(""))
    return F.struct(part(0).alias("city"), part(1).alias("region"), part(2).alias("country"))


def assignment(records: DataFrame) -> DataFrame:
    """The flat shape: names joined, single values as lists, places parsed, skills with their confidence and source."""
    one = lambda c: F.array_compact(F.array(c))
    score = F.round(F.col("confidence.fields")["skills"]["score"], 4)
    source = F.col("confidence.fields")["skills"]["source"]
    links = F.struct(*(F.coalesce(F.col(f"contact.{c}_url"), F.lit("")).alias(c) for c in ("linkedin", "github")))
    none = F.array().cast("array<struct<field:string,source:string,method:string>>")
    taken = F.transform("provenance", lambda p: F.struct(p.field.alias("field"), p.source.alias("source"), F.lit("Extracted").alias("method"))) if "provenance" in records.columns else none
    return records.select(
        "entity_key", F.col("id").alias("candidate_id"), strip(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"),
        one(F.col("contact.email")).alias("emails"), one(F.col("contact.phone")).alias("phones"), place(F.col("contact.location")).alias("location"), links.alias("links"),
        F.lit(None).cast("string").alias("headline"), F.lit(None).cast("double").alias("years_experience"),
        F.transform("skills", lambda s: F.struct(s.alias("name"), score.alias("confidence"), F.array(source).alias("sources"))).alias("skills"),
        F.col("experiences").alias("experience"), "education", taken.alias("provenance"), F.col("confidence.score").alias("overall_confidence"),
    )


def resolve(records: DataFrame, path: str) -> Column | None:
    """The column that a dotted path leads to; None where the records have no such field."""
    kind, at = records.schema, None
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            return None
        at = F.col(f"`{part}`") if at is None else at[part]
        kind = kind[part].dataType
    return at


def by_rules(records: DataFrame, rules: dict[str, dict[str, str]], missing: str = "omit") -> DataFrame:
    """entity_key, a JSON text with the fields that the rules name, under their output names, and field_count, how many.

    missing: `omit` leaves null fields out, and those that the records don't have; `null` writes them as null.
    """
    if not rules or any("output" not in r for r in rules.values()):
        raise ProjectionError("rules need a field and its output name")
    found = {rule["output"].strip(): resolve(records, path) for path, rule in rules.items()}
    shown = {name: F.lit(None).cast("string") if c is None else c for name, c in found.items() if c is not None or missing != "omit"}
    count = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), 1).otherwise(0) for c in shown.values()), F.lit(0)) if missing == "omit" else F.lit(len(shown))
    body = F.to_json(F.struct(*(c.alias(name) for name, c in shown.items())), {"ignoreNullFields": str(missing == "omit").lower()}) if shown else F.lit("{}")
    return records.select("entity_key", body.alias("json"), count.alias("field_count"))


SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {"canonical": canonical, "assignment": assignment}


def project(records: DataFrame, shape: str) -> DataFrame:
    if shape not in SHAPES:
        raise ProjectionError(f"unknown shape {shape}; there are {', '.join(sorted(SHAPES))}")
    return SHAPES[shape](records)


def report(records: DataFrame, shape: str) -> DataFrame:
    """A row per record: entity_key, projection_type, field_count (of the output, without the key) and warnings."""
    out = project(records, shape)
    return out.select("entity_key", F.lit(shape).alias("projection_type"), F.lit(len(out.columns) - 1).alias("field_count"), F.array().cast("array<string>").alias("warnings"))
