"""Where rows are, and where their columns are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task that does much for each of them, and rows below which a task is not worth its start.
MOST_ROWS, LEAST_ROWS = 10_000, 500


def spread(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """rows dealt evenly over tasks of at most `most`, over all cores if there are enough: a small file is read by one task,
    however much is made of its rows. They are counted first, so rows should be a table as it was read."""
    parts = _tasks(rows, most)
    return rows.repartition(parts) if parts > 1 else rows


def _tasks(rows: DataFrame, most: int) -> int:
    n = rows.count()
    return max(-(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))


def dealt(rows: DataFrame, kept: Callable[[DataFrame], DataFrame], key: str, most: int = MOST_ROWS) -> DataFrame:
    """What is kept of the rows, those of one key in one task, over as many tasks as `most` rows a task make of all rows:
    aggregates by the key, or by it and more, are then done in place. A shuffle that Spark plans has as many tasks for any
    number of rows, and the memory of one grows with the input."""
    return kept(rows).repartition(max(_tasks(rows, most), 1), key)


def made_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with more columns that are made once. Spark puts an expression in the place of a column made by it wherever that
    is read, filters included; an exploded one it can't."""
    made = rows.withColumn("_made", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.withColumns({n: F.col("_made").getField(n) for n in columns}).drop("_made")
