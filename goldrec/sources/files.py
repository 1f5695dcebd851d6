"""Files as rows, with the gate that every source shares. Errors are columns of a row, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5 * 1024 * 1024


def read_files(spark: SparkSession, path: str, audit: bool = True) -> DataFrame:
    """path, length, content of every file below a path or pattern.

    audit: a file that can't be read is a row without content, and the others go on; for that the files are read a second
    time, their contents dropped where they lie. Without it such a file ends the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not audit:
        return files.load(path).select("path", "length", "content")
    readable = files.option("ignoreCorruptFiles", "true").load(path).where("length IS NOT NULL")
    seen = readable.select(F.col("path").alias("_path"), (F.octet_length("content") >= 0).alias("_whole")).where("_whole")
    listed = files.load(path).select("path", "length")
    lost = listed.join(seen, F.col("path") == F.col("_path"), "left_anti")
    return readable.select("path", "length", "content").union(lost.select("path", "length", F.lit(None).cast("binary")))


def file_error(suffixes: tuple[str, ...], most: int = MOST_BYTES) -> tuple[Column, Column]:
    """(error_type, error_message) of the first check that a file fails: its suffix, its size, whether it could be read.
    That a path is there is checked by `missing_paths`."""
    known = F.lower("path").rlike(r"(%s)$" % "|".join(s.replace(".", r"\.") for s in suffixes))
    large, lost = F.col("length") > most, F.col("content").isNull()
    suffix = F.coalesce(F.nullif(F.regexp_extract("path", r"(\.[^./]+)$", 1), F.lit("")), F.lit("(none)"))
    said = F.when(~known, F.concat(F.lit("unsupported file extension: "), suffix, F.lit(f"; expected one of {', '.join(suffixes)}")))
    return F.when(~known | large | lost, F.lit("FileReadError")), said.when(large, F.lit(f"larger than {most} bytes")).when(lost, F.lit("cannot be read"))


def missing_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, error_type, error_message) of those paths or patterns that lead to nothing."""
    gone = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            gone.append((path, "FileNotFoundError", f"file not found: {path}"))
    return spark.createDataFrame(gone, "path string, error_type string, error_message string")


def json_text() -> Column:
    """The content of a JSON file as text: null if it isn't UTF-8, a byte order mark taken off."""
    return F.regexp_replace(F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")), r"^\uFEFF", "")


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rejects: what is known of them, error_type, error_message)."""
    key = [c for c in ("path", "entity_key", "doc_id") if c in rows.columns]
    good = rows.where("error_type IS NULL").drop("error_type", "error_message")
    return good, rows.where("error_type IS NOT NULL").select(*key, "error_type", *(c for c in ("error_message",) if c in rows.columns))
