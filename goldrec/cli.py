"""Five verbs over files: parse, merge, validate, project, transform.

Records go to standard output as JSON lines, or to a folder; rejected inputs are told of on standard error. The exit code
is 0 if nothing was rejected and every record is valid, else 1.
"""

from __future__ import annotations

import argparse
import sys
import traceback
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldrec.operators import projection
from goldrec.operators.resume import extract, to_records
from goldrec.plans import engine, errors
from goldrec.plans.config import Config, ConfigError, load_config, load_policy, load_projection
from goldrec.sources import ats, documents, records
from goldrec.sources.files import json_text, missing_paths, read_files, split_rejects


def _files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(files of all paths that are there, with the number of their argument; rejects)."""
    gone = missing_paths(spark, paths)
    lost = {r["path"] for r in gone.collect()}  # of the arguments
    found = [read_files(spark, p).withColumn("argument", F.lit(i)) for i, p in enumerate(paths) if p not in lost]
    every = None
    for files in found:
        every = files if every is None else every.unionByName(files)
    return every, gone.withColumnRenamed("path", "key")


def sources_of(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(records, rejects) of all files below the paths, each read by its suffix: .json, or .docx and .pdf. Resumes are
    read only where there are some: their plan is a large one."""
    files, rejects = _files(spark, paths)
    if files is None:
        return None, rejects
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    structured, bad = split_rejects(ats.from_files(files.where(suffix == "json")).drop("unknown_fields"))
    both, told = structured, [bad]
    lost = {r["key"] for r in rejects.collect()}  # of the arguments
    if any(not read_files(spark, p, audit=False).where(suffix.isin("docx", "pdf")).select("path").isEmpty() for p in paths if p not in lost):
        blocks, unread = documents.from_files(files.where(suffix.isin("docx", "pdf")))
        resumes, unnamed = split_rejects(to_records(extract(blocks)).drop("skipped_entries"))
        both, told = structured.unionByName(resumes), [bad, unread, unnamed]
    other = files.where(~suffix.isin("json", "docx", "pdf")).select(F.col("path").alias("key"), F.lit("UnsupportedFormatError").alias("error_type"), F.lit("expected .json, .docx or .pdf").alias("error_message"))
    for more in told:
        rejects = rejects.union(more.select(F.col(more.columns[0]), "error_type", "error_message"))
    return both, rejects.union(other)


def paired(sources: DataFrame) -> DataFrame:
    """Records of files whose names share a stem (`x`, `x_ats`, `x_resume`) as one entity, in the order of their paths."""
    stem = F.regexp_extract("entity_key", r"([^/]+?)(_ats|_resume)?\.[^./]+$", 1)
    keyed = sources.withColumns({"_path": F.col("entity_key"), "entity_key": stem})
    return keyed.withColumn("input_ord", F.row_number().over(Window.partitionBy("entity_key").orderBy("_path")) - 1).drop("_path")


def _config(args: argparse.Namespace) -> Config:
    config = load_config(args.config) if args.config else Config()
    if args.policy:
        config = replace(config, policy=load_policy(args.policy))
    return replace(config, region=args.region) if args.region else config


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    config, rules = _config(args), load_projection(args.rules) if args.rules else None
    shown = lambda rows: projection.by_rules(rows, rules, args.missing) if rules else engine.project(rows, args.format)
    if not rules and args.format not in projection.SHAPES:
        raise projection.ProjectionError(f"unknown shape {args.format}; there are {', '.join(sorted(projection.SHAPES))}")
    if args.verb in ("validate", "project"):
        files, rejects = _files(spark, args.paths)
        judged = None
        if files is not None:
            loaded, bad = split_rejects(records.from_json_text(files.select(F.col("path").alias("entity_key"), json_text().alias("json"))))
            rejects = rejects.union(bad.select("entity_key", "error_type", "error_message"))
            judged = engine.validate(loaded, config)
    else:
        sources, rejects = sources_of(spark, args.paths)
        judged = None
        if sources is not None:
            judged = engine.parse(sources, config) if args.verb == "parse" else engine.merge(paired(sources), config) if args.verb == "merge" else engine.transform(paired(sources), config)
    code = 0
    if judged is not None:
        judged = judged.persist()  # shown, and asked for its outcome
        bad = judged.where(F.col("error_type").isNotNull()) if "error_type" in judged.columns else judged.limit(0)
        if args.verb != "project" and "exit_code" in judged.columns:
            code = judged.agg(F.max("exit_code")).first()[0] or 0
        elif not bad.isEmpty():
            code = 1
        if "error_type" in judged.columns:
            rejects = rejects.union(bad.select("entity_key", "error_type", "error_message"))
        out = engine.envelope(judged).select("result.*") if args.envelope else shown(judged if "error_type" not in judged.columns else judged.where("error_type IS NULL")) if args.verb in ("project", "transform") else judged
        if args.output:
            records.write_json(out, args.output)
        else:
            for row in records.to_json_text(out).toLocalIterator():
                print(row["value"])
        judged.unpersist()
    for row in rejects.select("key", errors.message(F.col("error_type"), F.col("error_message")).alias("told")).toLocalIterator():
        code = 1
        print(f"{row['key']}: {row['told']}", file=sys.stderr)
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("goldrec")
    parser.add_argument("verb", choices=("parse", "merge", "validate", "project", "transform"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--format", default="canonical")
    parser.add_argument("--rules", help="YAML of a projection's fields")
    parser.add_argument("--missing", choices=("omit", "null"), default="omit")
    parser.add_argument("--policy", help="YAML of a merge policy")
    parser.add_argument("--config", help="folder with YAML of policy, confidence, validation, aliases")
    parser.add_argument("--region", help="of phone numbers without a country")
    parser.add_argument("--envelope", action="store_true", help="whole results: candidate, reports, warnings, success, exit_code")
    parser.add_argument("--output", "-o")
    parser.add_argument("--debug", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("goldrec").getOrCreate()
    try:
        return run(spark, args)
    except (ConfigError, projection.ProjectionError, AnalysisException, OSError) as error:
        if args.debug:
            traceback.print_exc()
        print(errors.of_exception(error), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
