"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

1. Each source's target share of the words follows its weight, at most `most` times its own size (excess is shared
   out again by weight). A source is dealt by hash into blocks of whole documents, in an order permuted by a keyed hash.
2. A target of k whole passes and a rest draws every block k times, and the first blocks of the permuted order once
   more, until the rest is reached; where it is reached, one document is cut to the missing words.
3. The sources' draw counts are exact quotas. A binary tree over the output shards divides them: at each node the left
   half's quotas are drawn from a multivariate hypergeometric distribution, seeded by the node, and the right half gets
   the others. The tree is grown by rounds of up to FAN children a node, twice: over the sums of groups of sources (at
   most GROUPS), then inside each group over its sources, whose draws in a node are those that the group got there. So
   a task holds one node's groups or one group's sources in a node, whatever the number of shards and sources. A leaf
   (a shard) holds, of every source, one range of draws, so that shards draw disjoint blocks.
4. A shard's rows are put in order by a keyed hash: a local shuffle.

A kept column that is named like an added one comes out as kept_ and its name (or in one struct, with `packed`).
A null source is a source, the last; a null text has no words and is never drawn for them but follows its block.
Repeated rows are drawn alike. An empty table gives an empty mix. Reruns agree: all randomness is keyed by `seed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from goldrec.llm.common import broadcast_if_small, fresh, key_of, materialize
from goldrec.llm.words import count_words

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words and documents of a block, and blocks that even a small source has.
BLOCK_WORDS, BLOCK_DOCS, BLOCKS = 65_536, 512, 64
#: Draws of an output shard; groups of sources; children of a node that a round of the splitting tree grows.
SHARD_DRAWS, GROUPS, FAN = 32, 256, 256
#: Columns that mix and copies add; a kept column of such a name comes out as kept_ and its name.
OWN = {"size", "source_size", "target", "taken", "shards", "shard", "words", "_pass"}


@F.arrow_udf(LongType())
def n_words(texts: pa.Array) -> pa.Array:
    """Words of each text (null: 0), counted over Arrow and not by their pattern."""
    return pa.array(count_words(texts), pa.int64())


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 0) in an order over all rows: ranges of it, the rows before each range, places inside."""
    part, before = fresh(rows, "part", "before")
    ranged = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(name)).select(part, F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(before))  # a row a range
    inside = Window.partitionBy(part).orderBy(*order)
    return ranged.join(F.broadcast(counts), part).withColumn(name, F.col(before) + F.row_number().over(inside) - 1).drop(part, before)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """Adds weight, target and the pass counts to a table (source, source_size, docs), one row a source.

    Sources are ordered by code point, null last; weights repeat. A level times its weight is a source's target, unless
    that exceeds `most` times its size, which it then gets; what is cut raises the level of the others, in rounds, until
    no further source is cut. Each round is a sum over the sources, however many there are.
    """
    placed = numbered(sizes, [F.col("source").isNull(), F.col("source")], "_place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    known = materialize(placed.withColumn("weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size")).drop("_place"))
    total = (known.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, None
    while level != before:
        cut = F.col("_cap") < F.lit(level) * F.col("weight")
        row = known.agg(F.sum(F.when(cut, F.col("_cap"))).alias("capped"), F.sum(F.when(~cut, F.col("weight"))).alias("free")).first()
        level, before = max(level, (total - (row["capped"] or 0.0)) / row["free"]) if row["free"] else float(2**60), level
    return (
        known.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("weight")))
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.expr("bigint(round(target)) div source_size")).otherwise(F.lit(0)))
        .withColumn("_rest", F.when(F.col("source_size") > 0, F.expr("bigint(round(target)) % source_size")).otherwise(F.lit(0)))
        .drop("_cap")
    )


def split_quotas(key: list[int], quotas: np.ndarray, totals: np.ndarray, node: int = 1) -> np.ndarray:
    """The leaves' quotas, a row a leaf, of the splitting tree below a node; leaf i draws totals[i] in all, and the
    quotas' sum is the totals'. It depends on the key, the node and its quotas and totals alone."""
    if len(totals) == 1:
        return quotas[None, :]
    middle = len(totals) // 2
    rng = np.random.default_rng([*key, node])
    left = rng.multivariate_hypergeometric(quotas, totals[:middle].sum(), method="marginals") if len(quotas) > 1 else totals[:middle].sum(keepdims=True)
    return np.concatenate([split_quotas(key, left, totals[:middle], 2 * node), split_quotas(key, quotas - left, totals[middle:], 2 * node + 1)])


def _tree(quotas: DataFrame, seed: int, shards: int, fan: int = FAN) -> DataFrame:
    """(_source, shard, _start, _quota): the range of a source's draws that a shard holds, from a table (_source, _group, _quota)."""
    root = (F.lit(0).cast("long").alias("_low"), F.lit(shards).cast("long").alias("_high"))
    groups = quotas.groupBy("_group").agg(F.sum("_quota").alias("_quota")).select(*root, "_group", "_quota")
    sources = quotas.select(*root, "_group", "_source", F.lit(0).cast("long").alias("_start"), "_quota")

    def of_node(own: pd.DataFrame) -> pd.DataFrame:
        """The children of a node, of nearly equal widths, with what each group of sources draws there."""
        own = own.sort_values("_group")
        low, high, names, held = int(own["_low"].iloc[0]), int(own["_high"].iloc[0]), own["_group"].to_numpy(), own["_quota"].to_numpy()
        edges = np.unique(low + (high - low) * np.arange(fan + 1) // fan)
        parts = split_quotas([seed, low, high], held, np.diff(held.sum() * (edges - low) // (high - low)))
        child, group = np.nonzero(parts)
        return pd.DataFrame({"_from": low, "_to": high, "_low": edges[child], "_high": edges[child + 1], "_group": names[group], "_quota": parts[child, group]})

    def of_group(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        """A group's sources in the children of a node: of every source, one range of its draws a child."""
        own, given = own.sort_values("_source"), given.sort_values("_low")
        held = own["_quota"].to_numpy()
        parts = split_quotas([seed + 1, int(own["_group"].iloc[0]), int(own["_low"].iloc[0]), int(own["_high"].iloc[0])], held, given["_quota"].to_numpy())
        starts = own["_start"].to_numpy() + parts.cumsum(0) - parts
        child, at = np.nonzero(parts)
        return pd.DataFrame({"_low": given["_low"].to_numpy()[child], "_high": given["_high"].to_numpy()[child], "_group": own["_group"].to_numpy()[at], "_source": own["_source"].to_numpy()[at], "_start": starts[child, at], "_quota": parts[child, at]})

    width = shards
    while width > 1:
        grown = groups.groupBy("_low", "_high").applyInPandas(of_node, "_from long, _to long, _low long, _high long, _group long, _quota long")
        last = width <= fan
        grown = grown if last else materialize(grown)
        drawn = sources.groupBy("_low", "_high", "_group").cogroup(grown.groupBy("_from", "_to", "_group")).applyInPandas(of_group, "_low long, _high long, _group long, _source long, _start long, _quota long")
        groups, sources = grown.drop("_from", "_to"), drawn if last else materialize(drawn)
        width = -(-width // fan)
    return sources.select("_source", F.col("_low").alias("shard"), "_start", "_quota")


def _block_plan(docs: DataFrame, seed: int, per_shard: int) -> DataFrame:
    """One row per block that is drawn: _source, _block, _passes, _rest (words left when its last turn comes), shards."""
    blocks = docs.groupBy("_source", "_block").agg(F.sum("size").alias("_words"), *(F.max(c).alias(c) for c in ("_passes", "_rest", "_blocks")))
    blocks = materialize(blocks.withColumn("_turn", F.xxhash64(F.lit(seed), "_source", "_block")).withColumn("_group", F.expr("shiftrightunsigned(_turn, 33) % bigint(ceil(sqrt(_blocks)))")))
    # Places and running words in the permuted order, in two levels of about sqrt(blocks) rows each.
    over_groups = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("_source", "_group").agg(F.sum("_words").alias("_w"), F.count(F.lit(1)).alias("_n"))
    groups = groups.select("_source", "_group", F.coalesce(F.sum("_w").over(over_groups), F.lit(0)).alias("_w0"), F.coalesce(F.sum("_n").over(over_groups), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_source", "_group").orderBy("_turn", "_block")
    ordered = materialize(
        blocks.join(groups, ["_source", "_group"])
        .withColumn("_place", F.col("_n0") + F.row_number().over(inside) - 1)
        .withColumn("_rest", F.greatest(F.lit(0), F.col("_rest") - (F.col("_w0") + F.sum("_words").over(inside) - F.col("_words"))))
        .withColumn("_copies", F.col("_passes") + F.when(F.col("_rest") > 0, 1).otherwise(0))
        .select("_source", "_block", "_passes", "_rest", "_copies", "_place")
    )
    quotas = materialize(ordered.groupBy("_source").agg(F.sum("_copies").alias("_quota"), F.count(F.lit(1)).alias("_n")).where("_quota > 0").withColumn("_group", F.pmod(F.xxhash64("_source"), F.lit(GROUPS))))
    shards = max(1, -(-(quotas.agg(F.sum("_quota")).first()[0] or 0) // per_shard))
    tree = _tree(quotas.select("_source", "_group", "_quota"), seed, shards)
    places = tree.select("_source", "shard", F.explode(F.expr("sequence(_start, _start + _quota - 1)")).alias("_draw"))
    drawn = ordered.where("_copies > 0")
    draws = (
        drawn.join(broadcast_if_small(quotas), "_source")
        .select("_source", "_block", "_place", "_n", F.explode(F.expr("sequence(0, int(_copies) - 1)")).alias("_pass"))
        .select("_source", "_block", "_pass", (F.col("_n") * F.col("_pass") + F.col("_place")).alias("_draw"))
    )
    given = draws.join(places, ["_source", "_draw"]).groupBy("_source", "_block").agg(F.expr("transform(sort_array(collect_list(struct(_pass, shard))), x -> x.shard)").alias("shards"))
    return drawn.select("_source", "_block", "_passes", "_rest").join(given, ["_source", "_block"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 7, per_shard: int = SHARD_DRAWS, keep: tuple[str, ...] = (), packed: bool = False, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, the `keep` columns, size, source_size, target (of its source), taken (words the
    mix takes, repeats counted) and shards (the output shard of each of its copies; the last may be cut).

    packed: the `keep` columns come as one struct `_kept`, with the names that they have.
    """
    kept = [F.struct(*(F.col(c) for c in keep)).alias("_kept")] if keep else []
    sized = docs.select(id_col, *kept, n_words(F.col(text)).alias("size"), F.col(source).alias("_name"), key_of(source).alias("_source"), key_of(id_col, text).alias("_row"))
    measured = materialize(sized.drop("_kept"))  # what all but the last step needs: texts are counted for it once
    known = materialize(targets(measured.groupBy("_source", F.col("_name").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, most, share).drop("source"))
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("docs") / BLOCK_DOCS))
    known = broadcast_if_small(known)
    dealt = lambda rows: rows.drop("_name").join(known, "_source").withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(seed)), F.col("_blocks")))
    slim = dealt(sized if keep else measured)
    plan = _block_plan(dealt(measured).select("_source", "_block", "size", "_passes", "_rest", "_blocks"), seed, per_shard)
    inside = Window.partitionBy("_source", "_block").orderBy("_row", id_col).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.coalesce(F.sum("size").over(inside), F.lit(0)))), F.lit(0))
    joined = slim.drop("_passes", "_rest").join(plan, ["_source", "_block"], "left").withColumn("taken", taken)
    if keep and not packed:
        kept = [F.col("_kept")[c].alias(f"kept_{c}" if c.lower() in OWN else c) for c in keep]
    return joined.select(id_col, *(["_kept"] if keep and packed else kept), "size", "source_size", "target", "taken", F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))


def copies(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, shuffled within its shard: shard, and words, how many of the leading words
    count (fewer than its size only in the one cut copy of a source). A document without words is copied for none."""
    each = mixed.select("*", F.posexplode("shards").alias("_pass", "shard")).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("_pass") * F.col("size")))
    return each.where("words > 0").drop("shards", "source_size", "target", "taken", "_pass")


def shuffled(rows: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """Brings each shard's rows together, in a random order that reruns repeat."""
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), id_col))
