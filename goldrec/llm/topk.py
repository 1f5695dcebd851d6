"""Exact top-k inner products by norm-bucketed retrieval.

1. Candidates of a dimension are cut at quantiles of their length (norm) into buckets, longest first.
2. Every query meets one block of the longest bucket; its k-th best score there is a true lower bound, its floor.
3. A query needs vectors no shorter than its floor over its own length. Queries of like needs form batches, and a batch
   meets only the buckets, block by block, whose longest vector is long enough for one of its queries.
4. In a block, the local cosine threshold (the floor over both lengths) decides how candidates are pruned: by length
   alone while it is low, or also by the query's largest coordinates and the rest's length (Cauchy-Schwarz) when it is
   high. Surviving products are verified in full.

Where all lengths are alike and no vectors are near each other, no bound can rule out much, and most products are made.

Vectors that are null or hold null or non-finite components take no part, nor rows without an id; only vectors of the
same dimension meet. A query's own row is no candidate of it; other rows of the same id are. Components
are floor(scale * x); sums must stay below 2**53, which is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldrec.llm.common import broadcast_if_small, materialize

SCALE, K = 1024, 10
#: Buckets of a dimension at most, rows that a bucket has about at least; rows of a candidate block, queries of a batch.
BUCKETS, BUCKET_LEAST, BLOCK, BATCH = 256, 256, 1024, 4096
#: Coordinates of the first look, and the cosine threshold from which it pays.
COORDINATES, HIGH_COSINE = 8, 0.6
EXACT = 2**53


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v (array of longs), dim, length: the rows that take part."""
    whole = f"{id_col} IS NOT NULL AND {vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    ints = rows.where(whole).select(F.col(id_col).alias("id"), F.expr(f"transform({vector}, x -> floor({scale} * double(x)))").alias("v"))
    norm2 = F.expr("aggregate(v, 0D, (a, x) -> a + double(x) * double(x))")
    fits = F.assert_true(F.col("norm2") < EXACT, "products of these vectors don't fit a double").isNull()
    return ints.select("id", "v", F.size("v").alias("dim"), norm2.alias("norm2")).where(fits).withColumn("length", F.sqrt("norm2")).drop("norm2")


def search_block(qv: np.ndarray, qrow: np.ndarray, floor: np.ndarray, cv: np.ndarray, cid: np.ndarray, crow: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query's place, candidate, score) of each query's k best in one block, as far as they reach the query's floor, and
    how many products were made in full."""
    ql, lengths = np.sqrt((qv * qv).sum(1)), np.sqrt((cv * cv).sum(1))
    order = np.argsort(-lengths, kind="stable")
    cv, cid, crow, lengths = cv[order], cid[order], crow[order], lengths[order]
    most = ql * lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        # Length pruning: only a prefix of the block is long enough. Scores are integers, so half a unit covers rounding.
        reach = np.where(floor > 0, np.searchsorted(-lengths, -(floor - 0.5) / ql, "right"), len(cv))
        local = np.where(most > 0, floor / most, -1.0)
    high = (local >= HIGH_COSINE) & (reach > 4 * k)
    out, made = [], 0
    for i in np.flatnonzero(high):
        q, n = qv[i], reach[i]
        lead = np.argsort(-np.abs(q), kind="stable")[:COORDINATES]
        part = cv[:n][:, lead]
        rest = max(0.0, ql[i] ** 2 - (q[lead] ** 2).sum()) * np.maximum(0.0, lengths[:n] ** 2 - (part * part).sum(1))
        rows = np.flatnonzero(part @ q[lead] + np.sqrt(rest) >= floor[i] - 0.5)
        made += len(rows)
        out += _best(i, cid[rows], cv[rows] @ q, floor[i], crow[rows] != qrow[i], k)
    low = np.flatnonzero(~high & (reach > 0))
    if len(low):
        made += len(low) * int(reach[low].max())
        scores = qv[low] @ cv[: int(reach[low].max())].T
        for row, i in zip(scores, low):
            out += _best(i, cid[: reach[i]], row[: reach[i]], floor[i], crow[: reach[i]] != qrow[i], k)
    return out, made


def _best(place: int, ids: np.ndarray, scores: np.ndarray, floor: float, others: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    good = np.flatnonzero((scores >= floor) & others)
    if len(good) > k:
        good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]  # with all ties at the edge
    order = np.lexsort((ids[good], -scores[good]))[:k]
    return [(int(place), int(ids[g]), int(scores[g])) for g in good[order]]


def _merge(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller id.

    Candidate blocks and query batches meet as a grid, a group a cell; both sides of a cell are bounded, so neither
    many queries nor a bucket that holds all rows meets in one task.
    """
    vectors = materialize(integer_vectors(rows, id_col, vector, scale).withColumn("_row", F.monotonically_increasing_id()))
    vectors = materialize(_bucketed(vectors, "length", BUCKETS, BUCKET_LEAST).withColumnRenamed("part", "bucket"))
    buckets = vectors.groupBy("dim", "bucket").agg(F.max("length").alias("_most"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    buckets = broadcast_if_small(materialize(buckets))
    blocked = vectors.join(buckets.drop("_most"), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("_row"), F.col("_blocks"))).drop("_blocks")
    asked = materialize(vectors.withColumnRenamed("id", id_col).where(is_query).select(F.col(id_col).alias("id"), "v", "dim", "length", "_row"))
    keys = ["dim", "bucket", "block", "batch"]

    def cell(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            qv, cv = np.stack(queries["v"].to_numpy()).astype(float), np.stack(candidates["v"].to_numpy()).astype(float)
            ids, numbers = queries["id"].to_numpy(), queries["_row"].to_numpy()
            found, _ = search_block(qv, numbers, queries["floor"].to_numpy(float), cv, candidates["id"].to_numpy(), candidates["_row"].to_numpy(), k)
            out = [(ids[i], numbers[i], c, score) for i, c, score in found]
        return pd.DataFrame(out, columns=["query_id", "_row", "vec_id", "score"]).astype("int64")

    def meet(queries: DataFrame, cells: DataFrame) -> DataFrame:
        """What is found in the cells (dim, bucket, block, batch) of queries (with a batch and a floor)."""
        known = broadcast_if_small(materialize(cells.select(*keys)))
        left = queries.join(known, ["dim", "batch"]).select(*keys, "id", "v", "_row", "floor")
        right = blocked.join(known, ["dim", "bucket", "block"]).select(*keys, "id", "v", "_row")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, _row long, vec_id long, score long")

    none = F.lit(float("-inf"))
    first = F.min("bucket").over(Window.partitionBy("dim"))
    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-asked.count() // BATCH))))).withColumn("floor", none)
    longest = materialize(buckets.withColumn("_first", first).where("bucket = _first").select("dim", "bucket", F.lit(0).cast("long").alias("block")))
    best = materialize(meet(dealt, dealt.select("dim", "batch").distinct().join(longest, "dim")))
    floors = best.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.min("score").cast("double").alias("floor")).where(F.col("_n") >= k).drop("_n")
    needy = asked.join(floors, "_row", "left").withColumn("floor", F.coalesce("floor", none))
    # A score is whole: half a unit covers rounding. Without a positive floor, no length is too short.
    needy = materialize(needy.withColumn("need", F.when((F.col("floor") > 0) & (F.col("length") > 0), (F.col("floor") - 0.5) / F.col("length")).otherwise(0.0)))
    parted = materialize(_bucketed(needy, "need", BUCKETS, BATCH))
    batches = parted.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("_batches"))  # counted apart from the vectors
    batched = parted.join(broadcast_if_small(materialize(batches)), ["dim", "part"]).withColumn("batch", F.xxhash64("part", F.pmod(F.xxhash64("_row"), F.col("_batches")))).drop("_batches")
    least = batched.groupBy("dim", "batch").agg(F.min("need").alias("_least"))
    cells = least.join(buckets, "dim").where("_most >= _least").withColumn("block", F.explode(F.expr("sequence(0L, _blocks - 1)"))).select(*keys)
    rest = cells.join(broadcast_if_small(longest), ["dim", "bucket", "block"], "left_anti")
    best = _merge(best.unionByName(meet(batched, rest)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bucketed(rows: DataFrame, value: str, most: int, least: int) -> DataFrame:
    """rows (of a written table) with `part`: which stretch between quantiles of the value, within the dimension, they lie
    in, highest first. There are at most `most` parts, with about `least` rows or more; equal values lie in one."""
    steps = [i / most for i in range(1, most)]
    cuts = rows.groupBy("dim").agg(F.percentile_approx(value, steps, 100 * most).alias("_cuts"), F.ceil(F.count(F.lit(1)) / least).alias("_parts"))
    cuts = cuts.select("dim", F.expr(f"array_distinct(transform(sequence(1, int(least({most}, greatest(_parts, 2))) - 1), i -> _cuts[int(i * {most} / least({most}, greatest(_parts, 2))) - 1]))").alias("_cuts"))
    return rows.join(broadcast_if_small(materialize(cuts)), "dim").withColumn("part", F.size(F.filter("_cuts", lambda c: c > F.col(value)))).drop("_cuts")
