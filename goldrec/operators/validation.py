"""Validation: a registry of rules, each a column of findings; findings are rows, the report is an aggregate of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.functions.phones import e164
from goldrec.functions.rows import made_once
from goldrec.functions.session import once_per_session
from goldrec.functions.text import bind, collapse, strip
from goldrec.plans.config import Config, ConfigError
from goldrec.schema import CONTACT_FIELDS

ISSUES = "array<struct<rule_name:string,severity:string,field:string,message:string,value:string>>"
BLOCKING = ("ERROR", "CRITICAL")
#: The shapes of an address, an external id and an id.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EXTERNAL_ID, EXTERNAL_ID_MOST = r"^[A-Za-z0-9._:-]+$", 128
UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
VERSIONS = ("1.0",)
#: Where a confidence key may point.
KNOWN = {"id", "first_name", "last_name", "external_id", "contact", "experiences", "education", "skills", "certifications", "languages", "confidence", "provenance", "schema_version"}


@dataclass(frozen=True)
class Rule:
    """name, severity, and what to look at: (record, configuration) -> array of (field, message, value)."""

    name: str
    severity: str
    findings: Callable[[Config], list[Column] | Column]


def _finding(when: Column, field, message: str | Column, value: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(lit(field).alias("field"), lit(message).alias("message"), value.cast("string").alias("value")))


def _indexed(name: str, test, part: str, message: str, value) -> Column:
    """Findings over a list's items, in order: `name[i].part`."""
    items = F.transform(F.coalesce(F.col(name), F.array()), lambda x, i: F.when(test(x, i), F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]" + (f".{part}" if part else ""))).alias("field"), F.lit(message).alias("message"), value(x).cast("string").alias("value"))))
    return F.filter(items, lambda x: x.isNotNull())


def _repeated(name: str, parts: tuple[str, ...], message: str) -> Column:
    key = lambda x: F.concat_ws("\x1f", *(collapse(F.lower(strip(F.coalesce(x[p].cast("string"), F.lit(""))))) for p in parts))
    keys = F.transform(F.coalesce(F.col(name), F.array()), key)
    said = lambda k, i: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("field"), F.lit(message).alias("message"), k.alias("value"))
    return bind(keys, lambda all_: F.filter(F.transform(all_, lambda k, i: F.when(F.array_position(all_, k) < i + 1, said(k, i))), lambda x: x.isNotNull()))


def _bad_score(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0) | (c > 1) | (c.cast("string") == "-0.0")


def _mixed(c: Column) -> Column:
    return c.rlike(r"\p{IsLatin}") & c.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")


def _scores(config: Config) -> list[Column]:
    each = F.transform(F.map_entries("confidence.fields"), lambda e: F.when(_bad_score(e.value.score), F.struct(F.concat(F.lit("confidence.fields."), e.key).alias("field"), F.lit("score is outside 0 to 1 or not finite").alias("message"), e.value.score.cast("string").alias("value"))))
    return [F.array(_finding(_bad_score(F.col("confidence.score")), "confidence.score", "score is outside 0 to 1 or not finite", F.col("confidence.score"))), F.coalesce(each, F.array())]


def _keys(config: Config) -> Column:
    def lost(key: Column) -> Column:
        head, rest = F.substring_index(key, ".", 1), F.expr("null")
        deep = F.instr(key, ".") > 0
        ok = F.when(head == "contact", ~deep | F.col("contact").isNull() | F.substring_index(key, ".", -1).isin(*CONTACT_FIELDS)).otherwise(~deep)
        return ~head.isin(*KNOWN) | ~ok

    found = F.transform(F.map_keys("confidence.fields"), lambda k: F.when(lost(k), F.struct(F.concat(F.lit("confidence.fields."), k).alias("field"), F.lit("key names no field of the record").alias("message"), k.alias("value"))))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array())


def _external(config: Config) -> list[Column]:
    c = F.col("external_id")
    message = F.when(strip(c) == "", "is blank").when(F.char_length(c) > EXTERNAL_ID_MOST, "is too long").when(~c.rlike(EXTERNAL_ID), "has characters that are not allowed")
    return [_finding(c.isNotNull() & message.isNotNull(), "external_id", message, c)]


#: In the order in which they run.
RULES = [
    Rule("required_fields", "ERROR", lambda k: [_finding(F.coalesce(strip(F.col(c)), F.lit("")) == "", c, "is required", F.col(c)) for c in ("first_name", "last_name")]),
    Rule("schema_version", "ERROR", lambda k: [_finding(~F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False)), "schema_version", "is not supported", F.col("schema_version"))]),
    Rule("confidence_values", "CRITICAL", _scores),
    Rule("string_length", "ERROR", lambda k: [F.array(*(_finding(F.char_length(c) > k.longest, c, "is too long", F.char_length(c)) for c in ("first_name", "last_name"))), _indexed("experiences", lambda x, i: F.char_length(x.description) > k.longest, "description", "is too long", lambda x: F.char_length(x.description))]),
    Rule("unicode_confusables", "WARNING", lambda k: [_finding(_mixed(F.col(c)), c, "mixes scripts", F.col(c)) for c in ("first_name", "last_name")]),
    Rule("id_uuid", "CRITICAL", lambda k: [_finding(~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "id", "is not a UUID", F.col("id"))]),
    Rule("email_format", "ERROR", lambda k: [_finding(~F.col("contact.email").rlike(EMAIL), "contact.email", "is not an e-mail address", F.col("contact.email"))]),
    Rule("phone_format", "WARNING", lambda k: [_finding(F.col("contact.phone").isNotNull() & e164(F.col("contact.phone"), k.region).isNull(), "contact.phone", "is not a valid number", F.col("contact.phone"))]),
    Rule("url_format", "WARNING", lambda k: [_finding(F.col(f"contact.{c}").isNotNull() & ~F.coalesce(F.lower(F.col(f"contact.{c}")).rlike("^https?://"), F.lit(False)), f"contact.{c}", "is not an http address", F.col(f"contact.{c}")) for c in CONTACT_FIELDS[3:]]),
    Rule("external_id_format", "ERROR", _external),
    Rule("duplicate_experience", "WARNING", lambda k: _repeated("experiences", ("company", "title", "start_date"), "repeats an earlier experience")),
    Rule("duplicate_education", "WARNING", lambda k: _repeated("education", ("institution", "degree"), "repeats an earlier education")),
    Rule("date_order", "ERROR", lambda k: [_indexed(n, lambda x, i: x.end_date < x.start_date, "end_date", "ends before it starts", lambda x: x.end_date) for n in ("experiences", "education")]),
    Rule("confidence_field_consistency", "WARNING", _keys),
]


@once_per_session
def _issues(rule: Rule, config: Config) -> Column:
    found = rule.findings(config)
    plain = "array<struct<field:string,message:string,value:string>>"
    if isinstance(found, list):
        # A list holds single findings or lists of findings.
        arrays = [f.cast(plain) if rule.name in ("confidence_values", "string_length", "date_order") else F.array(f).cast(plain) for f in found]
        found = F.concat(*arrays)
    found = F.filter(found.cast(plain), lambda x: x.isNotNull())
    return F.transform(found, lambda x: F.struct(F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), x.field.alias("field"), x.message.alias("message"), x.value.alias("value")))


def validate(records: DataFrame, config: Config | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Adds issues (in rule order, then list order), is_valid and summary."""
    rules = RULES if rules is None else rules
    names = [r.name for r in rules]
    if len({*names}) < len(names):
        raise ConfigError(f"rule names repeat: {names}")
    config = config or Config()
    every = F.concat(*(_issues(r, config) for r in rules)) if rules else F.array()
    # The rules read the scores many times, and the issues are read many times.
    if "confidence" in records.columns:
        records = made_once(records, {"confidence": F.col("confidence")}).select(records.columns)
    out = made_once(records, {"issues": every.cast(ISSUES)})
    count = lambda *which: F.size(F.filter("issues", lambda x: x.severity.isin(*which)))
    valid = count(*BLOCKING) == 0
    summary = F.concat(F.when(valid, "PASS").otherwise("FAIL"), F.lit(": "), count(*BLOCKING).cast("string"), F.lit(" error(s), "), count("WARNING").cast("string"), F.lit(f" warning(s) across {len(rules)} rule(s)"))
    return out.withColumns({"is_valid": valid, "summary": summary})


def report(validated: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row per record: entity_key, is_valid, issue counts by severity, rules_executed, and rules_failed (those that found
    something, in rule order)."""
    names = [r.name for r in (RULES if rules is None else rules)]
    count = lambda which: F.size(F.filter("issues", lambda x: x.severity == which)).cast("long").alias(f"n_{which.lower()}")
    failed = F.array_distinct(F.transform("issues", lambda x: x.rule_name))
    return validated.select("entity_key", "is_valid", *map(count, (*BLOCKING, "WARNING")), F.array(*map(F.lit, names)).alias("rules_executed"), failed.alias("rules_failed"))


def issue_rows(validated: DataFrame) -> DataFrame:
    return validated.select("entity_key", F.posexplode("issues").alias("issue_no", "i")).select("entity_key", "issue_no", "i.*")
