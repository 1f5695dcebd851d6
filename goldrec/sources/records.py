"""Canonical records as JSON text: reload, with or without an envelope, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from goldrec.functions.rows import made_once
from goldrec.functions.strict_json import one_document, shape_faults, void
from goldrec.operators.constraints import record_faults, told
from goldrec.schema import CANDIDATE_DDL, PROVENANCE

#: What a record that has been merged or scored holds beside its fields.
MORE_DDL = """confidence STRUCT<score:DOUBLE,fields:MAP<STRING,STRUCT<score:DOUBLE,source:STRING>>>, considered ARRAY<STRING>,
 merge_report ARRAY<STRUCT<field:STRING,strategy:STRING,conflict:BOOLEAN,contributing:ARRAY<STRING>,chosen:STRING,provenance:ARRAY<%s>>>""" % PROVENANCE


def record_type() -> StructType:
    """All that a written record may hold."""
    return StructType.fromDDL(", ".join((CANDIDATE_DDL, MORE_DDL)).replace("\n", " "))



def from_json_text(rows: DataFrame, today: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of rows (entity_key, json): the record itself or its envelope {"candidate": ...}.

    The text must be one whole JSON document. Types and keys are held against the record's schema at every depth, and
    values against the constraints of records (limits, dates, blanks; today bounds the start of an experience); a
    reject's message names each place at fault and why. provenance may be a list of entries or a map from the field; a
    null counts as missing. keep: columns of rows that come out beside the record.
    """
    record = record_type()
    entry = record["provenance"].dataType.elementType
    # In steps, each made once: what is wrong with a record is read by every column of the result.
    read = made_once(one_document(rows.select("entity_key", "json", *keep)), {"_v": F.expr("try_parse_json(json)")})
    inside = "try_variant_get(_v, '$.candidate', 'variant')"
    root = ~F.expr(void(inside))
    read = made_once(read, {"_v": F.when(root, F.expr(inside)).otherwise(F.col("_v"))})
    listed = F.expr("try_variant_get(_v, '$.provenance', 'map<string,variant>') IS NULL")
    unnamed = StructType([f for f in entry.fields if f.name != "field"])
    shapes = [StructType([*(f for f in record.fields if f.name != "provenance"), StructField("provenance", kind)]) for kind in (ArrayType(entry), MapType(StringType(), unnamed))]
    typed = F.when(listed, shape_faults("_v", shapes[0])).otherwise(shape_faults("_v", shapes[1]))
    read = made_once(read, {"_body": F.expr("to_json(_v)"), "_listed": listed, "_typed": F.when(F.expr("try_variant_get(_v, '$', 'map<string,variant>') IS NOT NULL"), typed)})
    read = made_once(read, {"_r": F.from_json("_body", record)})
    mapped = F.from_json(F.get_json_object("_body", "$.provenance"), MapType(StringType(), unnamed))
    named = F.transform(F.map_entries(mapped), lambda e: F.struct(e.key.alias("field"), e.value.source.alias("source"), e.value.raw_value.alias("raw_value"), e.value.extracted_at.alias("extracted_at")))
    given = F.when(F.col("_listed"), F.col("_r.provenance")).otherwise(named).cast(f"array<{PROVENANCE}>")
    kept = [F.col(f"_r.{c}") for c in record.names if c not in ("entity_key", "provenance")]
    out = read.select(F.coalesce("_r.entity_key", "entity_key").alias("entity_key"), *kept, given.alias("provenance"), *keep, "_typed", F.col("json").isNotNull().alias("_one"))
    out = made_once(out, {"_values": F.when(F.size("_typed") == 0, told(record_faults(today)))})
    values = F.col("_values")
    why = F.when(~F.col("_one"), "not a JSON document").when(F.col("_typed").isNull(), "the record is not an object").when(F.size("_typed") > 0, F.array_join("_typed", "; ")).when(values != "", values)
    kind = F.when(why.isNotNull(), F.when(F.col("_one"), "SchemaValidationError").otherwise("InvalidJSONError"))
    return out.withColumn("error_message", why).withColumn("error_type", kind).select(*(c for c in out.columns if c not in ("_typed", "_one", "_values")), "error_type", "error_message")


def to_json_text(records: DataFrame, nulls: bool = True) -> DataFrame:
    """A column `value`, one JSON document a row; null fields are written unless `nulls` is off."""
    return records.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not nulls).lower()}).alias("value"))


def write_json(records: DataFrame, path: str, by: str | None = None) -> None:
    """As JSON lines, a folder per value of `by` (a status, say) if given."""
    writer = records.write.option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)
