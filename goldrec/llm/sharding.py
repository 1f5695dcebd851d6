"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit hashes; a row belongs to the arc that ends at the first point
clockwise of its key's hash. All rows of an arc have the same preferences, so the bounded loads are planned over the
arcs' row counts (shards x vnodes numbers, however many rows): an arc fills its own shard, and what overflows a full
shard continues clockwise. Rows then take the planned places by joining on their rank in the arc.

With load_factor 1 (law `rows`) capacities are the row count divided by the shards, rounded down or up, so counts are
at most one apart; a larger factor moves fewer rows when shards are added.

Null keys hash as a value of their own; repeated rows get slots of their own; an empty table gives an empty result.
Columns named shard or slot come out as kept_ and their name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import aside, fresh, key_of, materialize, rank_in_groups

VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """The ring's points, ascending, and the shard of each. A shard's points don't depend on how many shards there are."""
    from goldrec.llm.words import mix, signed

    owners = np.repeat(np.arange(shards, dtype=np.uint64), vnodes)
    points = signed(mix(mix(owners * np.uint64(1 << 20) + np.tile(np.arange(vnodes, dtype=np.uint64), shards) + np.uint64(1))))
    order = np.argsort(points, kind="stable")
    return points[order], owners[order].astype(int)


def plan(counts: dict[int, int], owners: np.ndarray, shards: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """Rows (arc, first rank, rows, shard, first slot): what each arc sends where.

    Arcs first fill their own shards, in ring order; the overflow then continues clockwise from arc to arc, past full
    shards, until all of it lies somewhere.
    """
    total = sum(counts.values())
    if load_factor > 1:
        room = [math.ceil(load_factor * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], {}

    def put(arc: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((arc, rank, n, shard, used[shard]))
            used[shard] += n
        return n

    for arc in sorted(counts):
        done = put(arc, 0, counts[arc], int(owners[arc]))
        if done < counts[arc]:
            left[arc] = done
    for step in range(1, len(owners)):
        for arc in sorted(left):
            left[arc] += put(arc, left[arc], counts[arc] - left[arc], int(owners[(arc + step) % len(owners)]))
            if left[arc] == counts[arc]:
                del left[arc]
        if not left:
            break
    return out


def shard(rows: DataFrame, shards: int, key: str = "doc_id", tie: tuple[str, ...] = (), vnodes: int = VNODES, load_factor: float = 1.0) -> DataFrame:
    """Adds `shard` and `slot` (gapless from 0 in each shard) to rows.

    `rows` should be slim: it is written once to the shared folder. `tie` names further columns that tell rows of one
    key apart. The ring, the arcs' counts and the plan are bounded by shards x vnodes, not by the rows.
    """
    points, owners = ring(shards, vnodes)
    spark = rows.sparkSession
    clean = aside(rows, "shard", "slot")
    of_arc, rank, first, n, base = fresh(clean, "arc", "rank", "from", "n", "base")

    @F.pandas_udf("int")
    def arc(hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, hashes.to_numpy()) % len(points), dtype="int32")

    placed = materialize(clean.withColumn(of_arc, arc(key_of(key))))
    counts = {r[0]: r[1] for r in placed.groupBy(of_arc).agg(F.count(F.lit(1))).collect()}  # at most shards x vnodes rows
    planned = F.broadcast(spark.createDataFrame(plan(counts, owners, shards, load_factor), f"{of_arc} int, {first} long, {n} long, shard int, {base} long"))
    ranked = rank_in_groups(placed, [of_arc], [key, *tie], bounded_groups=True, name=rank)
    here = F.col(rank) - F.col(first)
    return ranked.join(planned, of_arc).where((here >= 0) & (here < F.col(n))).withColumn("slot", F.col(base) + here).select(*clean.columns, "shard", "slot")
