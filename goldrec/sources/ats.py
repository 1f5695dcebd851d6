"""Structured applicant documents: JSON text, a gate over its shape, and the canonical record.

The gate works on VARIANT, so that types are seen as they are written; the first rule that fails names the error. A
record with one bad nested item is rejected whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from goldrec.functions.dates import strict_date
from goldrec.functions.provenance import provenance
from goldrec.functions.rows import made_once
from goldrec.functions.session import once_per_session
from goldrec.functions.strict_json import one_document, shape_faults
from goldrec.functions.text import blank_to_null, dedup_exact, first_by, normal_url, strip
from goldrec.operators.constraints import Fault, blank, certification_faults, contact_faults, education_faults, experience_faults, told, too_many
from goldrec.schema import ATS_DDL, CONTACT_FIELDS
from goldrec.sources.files import file_error, json_text, read_files

#: The fields of a document and which of them are lists, of texts or of objects.
KNOWN = ("candidate_id", "first_name", "last_name", "email", "phone", "location", "linkedin_url", "github_url", "skills", "languages", "experience", "education", "certifications")
TEXT_LISTS, OBJECT_LISTS = ("skills", "languages"), ("experience", "education", "certifications")
LONGEST = 10_000


def read_ats(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records of JSON files, with error_type and error_message (null where all is well)."""
    return from_files(read_files(spark, path))


def from_files(files: DataFrame) -> DataFrame:
    """The same from rows (path, length, content)."""
    kind, message = file_error((".json",))
    gated = files.withColumns({"_kind": kind, "_message": message}).select(F.col("path").alias("entity_key"), json_text().alias("json"), "_kind", "_message")
    parsed = from_json_text(gated)
    return parsed.withColumn("error_message", F.coalesce("_message", "error_message")).withColumn("error_type", F.coalesce("_kind", "error_type")).drop("_kind", "_message")


def _kind_of(field: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get(_v, '$.{field}', 'variant'))")


def gate(rows: DataFrame) -> DataFrame:
    """Adds error_type, error_message and unknown_fields to rows with a `json` text."""
    rows = made_once(rows, {"_v": F.expr("try_parse_json(json)"), "_keys": F.expr("json_object_keys(json)")})
    shape, kind, message, unknown = _gate()
    rows = made_once(rows, {"_shape": shape})
    return rows.withColumns({"error_type": kind, "error_message": message, "unknown_fields": unknown}).drop("_v", "_keys", "_shape")


@once_per_session
def _gate() -> tuple[Column, Column, Column, Column]:
    """What is wrong with a document's shape, and the columns that tell of it, which read that as `_shape`."""
    root = F.expr("schema_of_variant(_v)").startswith("OBJECT")
    bad: list[tuple[Column, str]] = [(~F.coalesce(root, F.lit(False)), "the root is not an object")]
    for f in ("first_name", "last_name"):
        kind, value = _kind_of(f), F.expr(f"try_variant_get(_v, '$.{f}', 'string')")
        bad += [
            (~F.array_contains("_keys", f), f"{f} is missing"), (F.coalesce(kind, F.lit("VOID")) == "VOID", f"{f} is null"), (kind != "STRING", f"{f} is not a text"),
            (strip(value) == "", f"{f} is blank"), (F.char_length(value) > LONGEST, f"{f} is too long"),
        ]
    for f in TEXT_LISTS + OBJECT_LISTS:
        kind = F.coalesce(_kind_of(f), F.lit("VOID"))
        items = F.expr(f"transform(try_variant_get(_v, '$.{f}', 'array<variant>'), x -> schema_of_variant(x))")
        wanted, what = (lambda x: x == "STRING", "texts") if f in TEXT_LISTS else (lambda x: x.startswith("OBJECT"), "objects")
        bad += [((kind != "VOID") & ~kind.startswith("ARRAY"), f"{f} is not a list"), (kind.startswith("ARRAY") & ~F.forall(items, wanted), f"{f} has items that are not {what}")]
    shape = F.coalesce(*(F.when(test, F.lit(text)) for test, text in bad))
    unreadable = F.col("_v").isNull()
    kind = F.when(unreadable, "InvalidJSONError").when(F.col("_shape").isNotNull(), "SchemaValidationError")
    return shape, kind, F.when(unreadable, "not a JSON document").otherwise(F.col("_shape")), F.sort_array(F.array_except("_keys", F.array(*map(F.lit, KNOWN))))


def _mistyped(field: str, drop: tuple[str, ...] = ()) -> Column:
    """Does a list hold a value of another type than the document's schema says?"""
    items = StructType.fromDDL(ATS_DDL)[field].dataType.elementType
    kept = StructType([f for f in items.fields if f.name not in drop])
    return F.size(shape_faults(f"try_variant_get(_v, '$.{field}', 'variant')", ArrayType(kept), closed=False)) > 0


def map_document(rows: DataFrame, today: Column | None = None) -> DataFrame:
    """Canonical columns of gated rows. A record that breaks a constraint becomes a MappingError whose message names every
    field at fault and why; today bounds the start of an experience (the run's date if not given)."""
    lists, wrong, head, tail = _mapping(today)
    # In steps, each made once: a filter on the errors would have the documents parsed anew for every constraint.
    d = made_once(rows, {"_d": F.from_json("json", ATS_DDL), "_v": F.expr("try_parse_json(json)")})
    out = made_once(made_once(d, lists), {"_wrong": F.when(F.col("error_type").isNull(), wrong).otherwise(F.lit(""))})
    others = [c for c in rows.columns if c not in ("json", "entity_key", "error_type", "error_message")]
    return out.select(*head, *others, *tail)


@once_per_session
def _mapping(today: Column | None) -> tuple[dict[str, Column], Column, list[Column], list[Column]]:
    """The mapped lists, the faults of a record as one text, the record's columns and the error's."""
    today = F.current_date() if today is None else today
    get = lambda f: F.col(f"_d.{f}")
    some = reduce(lambda a, b: a | b, (get(f).isNotNull() for f in CONTACT_FIELDS))
    contact = F.struct(get("email").alias("email"), strip(get("phone")).alias("phone"), strip(get("location")).alias("location"), normal_url(get("linkedin_url")).alias("linkedin_url"), normal_url(get("github_url")).alias("github_url"))
    items = lambda f: F.coalesce(get(f), F.array())
    exp = F.transform(items("experience"), lambda x: F.struct(blank_to_null(x.company).alias("company"), blank_to_null(x.title).alias("title"), strict_date(x.start_date).alias("start_date"), strict_date(x.end_date).alias("end_date"), strip(x.description).alias("description"), dedup_exact(F.coalesce(x.skills, F.array())).alias("skills")))
    edu = F.transform(items("education"), lambda x: F.struct(blank_to_null(x.institution).alias("institution"), blank_to_null(x.degree).alias("degree"), strip(x.field_of_study).alias("field_of_study"), strict_date(x.start_date).alias("start_date"), strict_date(x.end_date).alias("end_date"), x.gpa.alias("gpa")))
    cert = F.transform(items("certifications"), lambda x: F.struct(blank_to_null(x["name"]).alias("name"), strip(x.issuer).alias("issuer"), strict_date(x.issued_date).alias("issued_date"), strict_date(x.expiry_date).alias("expiry_date")))
    lists = {"experiences": exp, "_edu": edu, "_cert": cert, "_skills": dedup_exact(items("skills")), "_languages": dedup_exact(items("languages"))}
    unread = lambda raw, name, end: F.exists(F.arrays_zip(items(raw).alias("r"), F.col(name).alias("m")), lambda z: z.r[end].isNotNull() & z.m[end].isNull())
    dates = "is not a date"
    whole = lambda f: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(_v, '$.{f}', 'variant'))"), F.lit("VOID"))
    faults: list[Fault] = [("external_id", ~whole("candidate_id").isin("STRING", "VOID"), "is not a text"), ("external_id", blank(get("candidate_id")), "is blank")]
    faults += [(f"contact.{f}", ~whole(f).isin("STRING", "VOID"), "is not a text") for f in CONTACT_FIELDS]
    faults += contact_faults(get)
    faults += [
        too_many("experiences", F.size("experiences")),
        ("experiences", _mistyped("experience", ("skills",)), "has a value that is not a text"),
        ("experiences", F.exists("experiences", lambda x: x.company.isNull() | x.title.isNull()), "lacks a company or title"),
        ("experiences", F.exists("experiences", lambda x: x.start_date.isNull()), "lacks a start date"),
        ("experiences", unread("experience", "experiences", "end_date"), f"end_date {dates}"),
        *experience_faults(F.col("experiences"), today),
        too_many("education", F.size("_edu")),
        ("education", _mistyped("education"), "has a value of a wrong type"),
        ("education", F.exists("_edu", lambda x: x.institution.isNull() | x.degree.isNull()), "lacks an institution or degree"),
        ("education", unread("education", "_edu", "start_date") | unread("education", "_edu", "end_date"), f"start_date or end_date {dates}"),
        *education_faults(F.col("_edu")),
        too_many("skills", F.size("_skills")),
        too_many("certifications", F.size("_cert")),
        ("certifications", _mistyped("certifications"), "has a value that is not a text"),
        ("certifications", F.exists("_cert", lambda x: x["name"].isNull()), "lacks a name"),
        ("certifications", unread("certifications", "_cert", "issued_date") | unread("certifications", "_cert", "expiry_date"), f"issued_date or expiry_date {dates}"),
        *certification_faults(F.col("_cert")),
        too_many("languages", F.size("_languages")),
    ]
    wrong = told(faults)
    fails = F.col("_wrong") != ""
    filled = lambda f: F.when(F.size(get(f)) > 0, F.to_json(get(f)))
    raw = {"first_name": get("first_name"), "last_name": get("last_name"), "external_id": get("candidate_id"), **{c: get(c) for c in CONTACT_FIELDS}, "skills": filled("skills"), "languages": filled("languages"), "experiences": filled("experience"), "education": filled("education"), "certifications": filled("certifications")}
    head = [
        F.col("entity_key"), F.lit("ATS").alias("source"), F.lit(0).alias("input_ord"), F.lit(None).cast("string").alias("id"), strip(get("first_name")).alias("first_name"), strip(get("last_name")).alias("last_name"),
        blank_to_null(get("candidate_id")).alias("external_id"), F.when(some, contact).alias("contact"), "experiences", F.col("_edu").alias("education"),
        F.col("_skills").alias("skills"), first_by(F.col("_cert"), lambda x: F.lower(x["name"])).alias("certifications"), F.col("_languages").alias("languages"), provenance("ATS", raw).alias("provenance"),
        F.lit("1.0").alias("schema_version"),
    ]
    return lists, wrong, head, [F.when(fails, "MappingError").otherwise(F.col("error_type")).alias("error_type"), F.when(fails, F.col("_wrong")).otherwise(F.col("error_message")).alias("error_message")]


def from_json_text(rows: DataFrame, today: Column | None = None) -> DataFrame:
    """rows have entity_key and json (null: unreadable), which must be one whole document: nothing but white space may
    stand around it. A byte order mark before it is passed over; of repeated keys the last counts."""
    return map_document(gate(one_document(rows.withColumn("json", F.regexp_replace("json", r"^\uFEFF", "")))), today)
