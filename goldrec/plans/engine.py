"""The verbs: parse, merge, validate, project, transform; each a composition of DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.operators import confidence, merge as merging, normalize, projection, validation
from goldrec.plans.config import Config
from goldrec.plans.reports import Reports
from goldrec.sources import records

CANONICAL = ["entity_key", "source", "input_ord", "first_name", "last_name", "external_id", "contact", "experiences", "education", "skills", "certifications", "languages"]


OPTIONAL = ["provenance", "confidence"]


def with_outcome(rows: DataFrame) -> DataFrame:
    """Adds success and exit_code: 0 if the record is valid (or nothing was validated) and has no error."""
    good = F.lit(True)
    if "is_valid" in rows.columns:
        good = good & F.col("is_valid")
    if "error_type" in rows.columns:
        good = good & F.col("error_type").isNull()
    return rows.withColumn("success", good).withColumn("exit_code", F.when(good, 0).otherwise(1))


def _with_id(rows: DataFrame) -> DataFrame:
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return rows.withColumn("id", F.coalesce("id", F.concat_ws("-", *(F.substring(F.md5(F.col("entity_key")), a, n) for a, n in parts))))


def parse(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Records of one source each: normalized, scored by themselves, validated."""
    config = config or Config()
    scored = confidence.score(_with_id(normalize.normalize(rows, config)), config.scoring, single=True)
    return with_outcome(validation.validate(scored, config))


def merge(sources: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    raw = sources.select(*CANONICAL, *(c for c in OPTIONAL if c in sources.columns))
    return merging.merge(normalize.normalize(raw, config), config.policy, raw=raw)


def validate(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Existing records, with the confidence that they carry."""
    return with_outcome(validation.validate(rows, config))


def transform(sources: DataFrame, config: Config | None = None, reports: Reports | None = None) -> DataFrame:
    """All stages up to validation; `projection.project` takes it from there. reports watches the stages, if given."""
    config, watch = config or Config(), reports.watch if reports else lambda stage, rows: rows
    golden = watch("merge", merge(sources, config))
    scored = watch("confidence", confidence.score(golden, config.scoring))
    return with_outcome(watch("validation", validation.validate(scored, config)))


def envelope(judged: DataFrame) -> DataFrame:
    """One column `result` a record: candidate (what `records` reads back), reports by stage, warnings (conflicts and
    issues that don't block), success, exit_code."""
    has = lambda c: c in judged.columns
    candidate = F.struct(*(c for c in records.record_type().names if has(c)))
    stages = {"merge": F.col("merge_report") if has("merge_report") else None, "confidence": F.col("confidence_trace") if has("confidence_trace") else None}
    if has("issues"):
        failed = F.array_distinct(F.transform("issues", lambda x: x.rule_name))
        stages["validation"] = F.struct("is_valid", "summary", "issues", F.array(*(F.lit(r.name) for r in validation.RULES)).alias("rules_executed"), failed.alias("rules_failed"))
    none = F.array().cast("array<string>")
    disagree = F.transform(F.filter("merge_report", lambda r: r.conflict), lambda r: F.concat(F.lit("sources disagree on "), r.field)) if has("merge_report") else none
    weak = F.transform(F.filter("issues", lambda x: x.severity == "WARNING"), lambda x: F.concat(x.field, F.lit(" "), x.message)) if has("issues") else none
    reports = F.struct(*(c.alias(n) for n, c in stages.items() if c is not None))
    told = with_outcome(judged) if not has("success") else judged
    return told.select(F.struct(candidate.alias("candidate"), reports.alias("reports"), F.concat(disagree, weak).alias("warnings"), "success", "exit_code").alias("result"))


def project(rows: DataFrame, shape: str) -> DataFrame:
    return projection.project(rows, shape)
