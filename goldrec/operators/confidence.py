"""Explainable confidence: per field an ordered fold of scoring steps, clamped to 0..1 after each, with its trace.

Everything is a column expression over one golden (or single-source) record; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.functions.rows import made_once
from goldrec.functions.session import once_per_session
from goldrec.functions.text import bind
from goldrec.plans.config import ConfigError, Scoring

#: What a field's steps see: its value is missing, it is in conflict, how many sources gave it, all sources considered.
Facts = dict[str, Column]


def missing(record: DataFrame, name: str) -> Column:
    kind = record.schema[name].dataType.typeName()
    return F.coalesce(F.size(name), F.lit(0)) <= 0 if kind == "array" else (F.col(name) == "") | F.col(name).isNull() if kind == "string" else F.col(name).isNull()


def delta(step: str, running: Column, facts: Facts, scoring: Scoring) -> Column:
    if step == "source_weight":
        table = F.create_map(*(F.lit(x) for pair in scoring.sources.items() for x in pair))
        return F.coalesce(F.array_max(F.transform(facts["considered"], lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0.0)))), F.lit(0.0))
    if step == "agreement":
        return F.when((facts["contributing"] > 1) & ~facts["conflict"], F.lit(scoring.bonus)).otherwise(F.lit(0.0))
    if step == "conflict_penalty":
        return F.when(facts["conflict"], F.lit(-scoring.penalty)).otherwise(F.lit(0.0))
    if step == "missing_field":
        return F.when(facts["missing"], -running).otherwise(F.lit(0.0))
    raise ConfigError(f"unknown scoring step {step}")


def _facts(single: bool, given: Column) -> Column:
    """The facts of each field of `given` (field, weight, missing). A merged record's come from its merge_report, a parent
    field's from its children; a single source agrees with nobody and contradicts nobody."""

    def of(m: Column) -> Column:
        told = lambda conflict, contributing, considered: F.struct(m.field.alias("field"), m.weight.alias("weight"), m.missing.alias("missing"), conflict.alias("conflict"), contributing.alias("contributing"), considered.alias("considered"))
        if single:
            return told(F.lit(False), F.lit(1), F.array("source"))
        own = F.filter("merge_report", lambda x: (x.field == m.field) | x.field.startswith(F.concat(m.field, F.lit("."))))
        return bind(own, lambda r: told(F.exists(r, lambda x: x.conflict), F.size(F.array_distinct(F.flatten(F.transform(r, lambda x: x.contributing)))), F.col("considered")))

    return F.transform(given, of)


def _walk(f: Column, scoring: Scoring) -> Column:
    """field, weight (0 where a missing value lost a score), score and trace of one field: its steps one after another."""

    def after(steps: tuple[str, ...], running: Column, done: list[Column], lost: Column) -> Column:
        if not steps:
            return F.struct(f.field.alias("field"), F.when(lost, 0.0).otherwise(f.weight).alias("weight"), running.alias("score"), F.array(*done).alias("trace"))
        step = steps[0]
        facts = {k: f[k] for k in ("missing", "conflict", "contributing", "considered")}

        def scored(change: Column) -> Column:
            def entered(new: Column) -> Column:
                entry = F.struct(f.field.alias("field"), F.lit(step).alias("step"), running.alias("old_score"), change.alias("delta"), new.alias("new_score"))
                return after(steps[1:], new, [*done, entry], change < 0 if step == "missing_field" else lost)

            return bind(F.greatest(F.lit(0.0), F.least(F.lit(1.0), running + change)), entered)

        return bind(delta(step, running, facts, scoring), scored)

    return after(tuple(scoring.steps), F.lit(0.0), [], F.lit(False))


@once_per_session
def _scored(scoring: Scoring) -> Column:
    return F.transform("_facts", lambda f: _walk(f, scoring))


#: Why a step changed a score, for the texts of bonuses and penalties.
REASONS = {"source_weight": "base weight of the source", "agreement": "sources agree", "conflict_penalty": "sources disagree", "missing_field": "value is missing"}


def notes(trace: str = "confidence_trace") -> tuple[Column, Column]:
    """(bonuses, penalties) of a trace, a text for each change: `field: reason (+0.100)`; without the number for a value
    that is missing."""
    why = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    told = lambda t: F.concat(t.field, F.lit(": "), F.try_element_at(why, t.step))
    number = lambda t: F.format_string("%.3f", t.delta)
    bonuses = F.transform(F.filter(trace, lambda t: t.delta > 0), lambda t: F.concat(told(t), F.lit(" (+"), number(t), F.lit(")")))
    penalties = F.transform(F.filter(trace, lambda t: t.delta < 0), lambda t: F.when(t.step == "missing_field", told(t)).otherwise(F.concat(told(t), F.lit(" ("), number(t), F.lit(")"))))
    return bonuses, penalties


def score(record: DataFrame, scoring: Scoring | None = None, single: bool | None = None) -> DataFrame:
    """Adds confidence (score, fields: name -> score, source) and confidence_trace (field, step, old, delta, new).

    single: whether a record comes from one source, told by the columns if not given: merged records have a
    merge_report, others a source; records with neither can't be scored.

    A field that is missing and lost a positive score is left out of the weighted mean. A row's `source` (if single) or
    first considered source is a field's reported source.
    """
    scoring = scoring or Scoring()
    if single is None:
        if not {"merge_report", "source"} & set(record.columns):
            raise ConfigError("records without a merge_report and without a source can't be scored")
        single = "merge_report" not in record.columns
    given = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(float(w)).alias("weight"), missing(record, n).alias("missing")) for n, w in scoring.fields.items()))
    # In steps, so that none's work is repeated where the next reads it: facts, all fields' steps, what is told of them.
    out = made_once(record.withColumn("_facts", _facts(single, given)), {"_scored": _scored(scoring)})
    source = F.col("source") if single else F.coalesce(F.try_element_at("considered", F.lit(1)), F.lit("ATS"))
    fields = F.map_from_entries(F.transform("_scored", lambda s: F.struct(s.field.alias("key"), F.struct(s.score.alias("score"), source.alias("source")).alias("value"))))
    weight = F.aggregate("_scored", F.lit(0.0), lambda a, s: a + s.weight)
    total = F.aggregate("_scored", F.lit(0.0), lambda a, s: a + s.weight * s.score)
    overall = F.when(weight > 0, total / weight).otherwise(0.0)
    told = {"confidence": F.struct(overall.alias("score"), fields.alias("fields")), "confidence_trace": F.flatten(F.transform("_scored", lambda s: s.trace))}
    return made_once(out, told).drop("_facts", "_scored")
