"""Helpers that several operators share: written intermediate tables, bounded broadcasts, ranks in hot groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if a count has shown it to have no more rows than this.
BROADCAST_ROWS = 50_000

#: Spark's own switch that removes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Settings while a table is written: no shuffle files afterwards, Arrow batches of long texts that stay small.
WRITING = {SHUFFLE_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a session that is one
    process (master local) gets a folder of its machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='goldrec-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that lost executors cost no lineage.

    The table's files go when the JVM ends; the shuffle files that made it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/goldrec/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from materialize that nothing reads any more, before the JVM ends."""
    for table in tables:
        for name in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Marks a written table for broadcast if it has at most that many rows; else the join shuffles as usual.

    items: an array column whose items are counted instead of the rows, which it may outgrow.
    """
    count = df.agg(F.sum(F.greatest(F.size(items), F.lit(1))).alias("n")).first()["n"] or 0 if items else df.count()
    return F.broadcast(df) if count <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *outputs: str) -> DataFrame:
    """df with each column that is named like an output renamed to kept_ and its name."""
    clash = {c for c in df.columns if c.lower() in {o.lower() for o in outputs}}
    return df.withColumnsRenamed(dict(zip(clash, fresh(df, *(f"kept_{c}" for c in clash))))) if clash else df


def key_of(*cols: str) -> Column:
    """A 64-bit key of columns in which nulls count as values of their own."""
    return F.xxhash64(*(x for c in cols for x in (F.col(c).isNull(), F.col(c))))


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], *, bounded_groups: bool, name: str = "rank") -> DataFrame:
    """Adds the place (from 0) of each row in its group, with no task ever holding a whole group.

    A group of n rows is dealt by a hash of `order` into about sqrt(n) chunks; a chunk's rows are numbered where they
    lie and shifted by the rows of the chunks before it. Rows that tie on all of `order` are interchangeable. `df`
    must be cheap to read twice (a written table). bounded_groups: the number of groups has a bound that doesn't grow
    with the data, so that the table of group sizes may be broadcast. Keys must not be null.
    """
    chunk, chunks, start, n = fresh(df, "chunk", "chunks", "start", "n")
    sizes = df.groupBy(*keys).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias(chunks))
    dealt = df.join(F.broadcast(sizes) if bounded_groups else sizes, keys).withColumn(chunk, F.pmod(key_of(*order), F.col(chunks))).drop(chunks)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = Window.partitionBy(*keys, chunk).orderBy(*order)
    return dealt.join(starts, [*keys, chunk]).withColumn(name, F.col(start) + F.row_number().over(within) - 1).drop(chunk, start)


def number_in_order(rows: DataFrame, keys: list[str], order: list[str], name: str = "place", size: str = "n") -> DataFrame:
    """Adds each row's place (from 0) in its group's order, nulls first, and the group's size; no task holds a whole group.

    `rows` is a written table and its keys are not null. Rows are dealt by ranges of keys, order and their own number in
    the table, so that neither a hot group nor equal rows meet in one task; in a written part they lie in order, and a
    part's rows of a group are shifted by those of the parts before it. Rows that tie on all of `order` are
    interchangeable.
    """
    tie, at, part, first, start = fresh(rows, "_tie", "_at", "_part", "_first", "_start")
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order, tie)]
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(spread.drop(tie).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    parts = dealt.groupBy(*keys, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, part, first, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start), F.sum(size).over(Window.partitionBy(*keys)).alias(size))
    return dealt.join(broadcast_if_small(materialize(starts)), [*keys, part]).select(*rows.columns, (F.col(at) - F.col(first) + F.col(start)).alias(name), size)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each end of a link, the smallest node that links lead to.

    Labels go to neighbours as minima and jump to their label's label, round by round, until none changes; every round
    is a written table. Joins are between plain shuffles, so that adaptive execution can split a hub's rows.
    """
    ends = [links.select(F.col(x).alias("node"), F.col(y).alias("near")) for x, y in ((a, b), (b, a))]
    edges = materialize(ends[0].union(ends[1]).where("node <> near"))
    labels = materialize(edges.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("component").alias("_heard"))
        told = materialize(labels.join(heard, "node").select("node", F.least("component", "_heard").alias("component"), F.col("component").alias("_old")))
        jump = told.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = materialize(told.join(jump, "component").select("node", F.least("component", "_next").alias("component"), "_old"))
        labels = moved.select("node", "component")
        if moved.where("component <> _old").isEmpty():
            return labels
