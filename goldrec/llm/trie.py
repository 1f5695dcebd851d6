"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A round takes the next turns of those that are still in a class with
others, splits each class by turn, and writes what it found; a class that is down to one conversation is retired, its
rest becomes an unary chain of nodes at the end, and its turns take no part in later rounds. Rounds look at 2, 4, 8 ...
up to 512 turns, so that long shared beginnings take few rounds while a task holds at most so many turns of a
conversation. A class is known by a digest of its class above and its turn. Sums over subtrees then fold back from the
conversations: a node's value is kept once, with its smallest member, and each conversation brings what it keeps to all
shared nodes on its way.

Rows without a conv_id belong to no conversation and are left out. Turns are ordered by number, null first, equal ones by
a digest of role and text; null roles and texts are empty ones; repeated rows are turns each. An empty table has no
nodes. Conversations of any length and classes of any size are dealt to many tasks; the list of the members that end at a
node is hashed as a stream, in one task per node, from pieces that are joined elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldrec.llm.common import materialize, number_in_order

#: Turns that a round looks at, from the first round to all later ones; bytes of a piece of joined ids.
FIRST, MOST = 2, 512
PIECE = 1 << 14
#: Conversations of one block take their first turns from the block's first one.
BLOCK, HEADS = 100, 6

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def rebuild(conversations: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Written tables of the rebuilt conversations: (conv, depth from 1, digest, chars, last) a turn, with the `keep`
    columns under their names after kept_, and (conv, length) a conversation, turnless ones too.

    A conversation c takes its first h turns from conversation c - c % 100, as far as that has them, and goes on with its
    own turns after its first h; h is the CRC-32 of its decimal number modulo 6.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("_turn"), digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"), *(F.col(c).alias(f"kept_{c}") for c in keep)
    )
    turns = materialize(number_in_order(materialize(own), ["conv"], ["_turn", "digest"]).drop("_turn"))
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = turns.where("place = 0").select("conv", "n", heads.alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    bases = convs.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("n").alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("from_base", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("length", F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv", "base", "h", "from_base", "length"))
    kept = ["digest", "chars", *(f"kept_{c}" for c in keep)]
    first = turns.where(f"conv % {BLOCK} = 0 AND place < {HEADS}").withColumnRenamed("conv", "base").join(convs, "base").where("place < h")
    later = turns.join(convs, "conv").where("place >= h")
    rows = [t.select("conv", at.alias("depth"), *kept, (at == F.col("length")).alias("last")) for t, at in ((first, F.col("place") + 1), (later, F.col("place") - F.col("h") + F.col("from_base") + 1))]
    return materialize(rows[0].union(rows[1])), convs.select("conv", "length")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _split(rest: DataFrame, until: int) -> DataFrame:
    """The next turns of each conversation, with digests of all from the first on: its class and the one above, a turn."""
    turns = F.sort_array(F.collect_list(F.struct("depth", "digest", "chars", "last")))
    block = rest.where(F.col("depth") <= until).groupBy("conv").agg(turns.alias("turns"), F.min("key").alias("start"))
    step = "named_struct('key', unhex(sha2(concat({0}, t.digest), 256)), 'up', {0}, 'depth', t.depth, 'chars', t.chars, 'last', t.last)"
    kind = "array<struct<key: binary, up: binary, depth: bigint, chars: bigint, last: boolean>>"
    walk = f"aggregate(turns, cast(array() AS {kind}), (seen, t) -> concat(seen, array({step.format('if(size(seen) = 0, start, element_at(seen, -1).key)')})))"
    return block.select("conv", F.expr(f"inline({walk})"))


def refine(turns: DataFrame, convs: DataFrame, first: int = FIRST, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: nodes that conversations share (with the root), the members of each, and retired conversations.

    nodes: node (smallest member), depth, parent, n, chars, ends (members that end here), end (the smallest of them);
    members: conv, depth, node, last, ends; retired: conv, depth (its first node alone), parent.
    """
    root = F.unhex(F.sha2(F.lit(""), 256))
    ended = F.col("length") == 0
    top = convs.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"), F.count_if(ended).alias("ends"), F.min(F.when(ended, F.col("conv"))).alias("end")).where("n > 0")
    top = materialize(top.select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("chars"), "ends", "end", root.alias("key")))
    found = top.first()  # one row
    node, ends = (found["node"], found["ends"]) if found else (None, None)
    nodes, retired = [top.drop("key")], []
    members = [materialize(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(node).cast("long").alias("node"), ended.alias("last"), F.lit(ends).cast("long").alias("ends")))]
    rest, classes, at, width = turns.select("conv", "depth", "digest", "chars", "last").withColumn("key", root), top.select("key", "node", "n"), 0, first
    while not rest.isEmpty():
        rows = materialize(_split(rest, at + width))
        one = rows.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"), F.min("up").alias("up"), F.min("chars").alias("chars"), F.count_if("last").alias("ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end"))
        one = materialize(one)
        above = one.where("n > 1").select("key", "node", "n").union(classes).select(F.col("key").alias("up"), F.col("node").alias("parent"))
        split = materialize(one.join(above, "up").select("node", "depth", "parent", "n", "chars", "ends", "end", "key"))
        shared = split.where("n > 1")
        here = materialize(rows.select("conv", "key", "last").join(shared.select("key", "node", "depth", "ends"), "key"))
        nodes.append(shared.drop("key"))
        members.append(here.select("conv", "depth", "node", "last", "ends"))
        retired.append(split.where("n = 1").select(F.col("node").alias("conv"), "depth", "parent"))
        at, width = at + width, min(2 * width, most)
        active = here.where(F.col("depth") == at).select("conv", "key")
        classes = shared.where(F.col("depth") == at).select("key", "node", "n")
        rest = materialize(rest.where(F.col("depth") > at).drop("key").join(active, "conv"))
    none = turns.sparkSession.createDataFrame([], "conv long, depth long, parent long")
    return _union(nodes), _union(members), _union([*retired, none])


def joined_sha256(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """For each key, the SHA-256 of its numbers in ascending order, decimal, joined by commas; rows is a written table.

    Ranges of rows, in order, are joined into pieces where they lie; a key's pieces then pass through a running hash.
    """
    by = [*keys, number]
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, texts, size = None, 0, [], 0
        for batch in batches:
            out = []
            for *key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now or size > PIECE:
                    if texts:
                        out.append((*now, first, ",".join(texts)))
                    now, first, texts, size = key, value, [], 0
                texts.append(str(value))
                size += len(texts[-1]) + 1
            if out:
                yield as_batch(out)
        if texts:
            yield as_batch([(*now, first, ",".join(texts))])

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in [*zip(*out)][:-1]), pa.array([r[-1] for r in out], pa.string())], names=[*keys, "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    state.update(b",")
                else:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*keys, "sha256"])

    dealt = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    parts = materialize(dealt.mapInArrow(pieces, f"{kinds}, first long, piece string"))
    return materialize(parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, f"{kinds}, sha256 string"))


def _suffix(owned: DataFrame) -> DataFrame:
    """(node, depth, below): the values that a conversation keeps from a depth on, summed in stretches and over them."""
    chunked = owned.withColumn("chunk", F.floor(F.col("depth") / MOST))
    before = Window.partitionBy("node").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = chunked.groupBy("node", "chunk").agg(F.sum("value").alias("value")).select("node", "chunk", F.coalesce(F.sum("value").over(before), F.lit(0)).alias("later"))
    inside = Window.partitionBy("node", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return chunked.join(later, ["node", "chunk"]).select("node", "depth", (F.sum("value").over(inside) + F.col("later")).alias("below"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over written tables as from `rebuild`; see NODE for its columns.

    A node is named by its smallest member and its depth. saved_tokens sums (n_convs - 1) times the characters of the last
    turn over the node's subtree; n_leaves counts the childless nodes in it; both with the node itself.
    """
    nodes, members, retired = refine(turns, convs)
    children = nodes.where("parent IS NOT NULL").select("parent", "depth").union(retired.select("parent", "depth"))
    children = children.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("value", (F.col("n") - 1) * F.col("chars")))
    kept = nodes.select(F.col("node").alias("conv"), "value", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf")).union(retired.select("conv", F.lit(0).cast("long"), F.lit(1)))
    kept = kept.groupBy("conv").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"))
    brought = members.select("conv", "node", "depth").join(kept, "conv")
    brought = brought.groupBy("node", "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("conv") != F.col("node"), F.col("value")).otherwise(0)).alias("others"))
    many = members.where("last AND ends > 1").select("node", "depth", "conv")
    ends = joined_sha256(many, ["node", "depth"], "conv")
    whole = nodes.join(brought, ["node", "depth"]).join(_suffix(nodes), ["node", "depth"]).join(ends, ["node", "depth"], "left")
    nobody, alone = F.lit(hashlib.sha256().hexdigest()), lambda c: F.sha2(F.col(c).cast("string"), 256)
    shared = whole.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("others") + F.col("below")).alias("saved_tokens"),
        F.when(F.col("ends") == 0, nobody).when(F.col("ends") == 1, alone("end")).otherwise(F.col("sha256")).alias("ends_sha256"),
    )
    begins = retired.select("conv", F.col("depth").alias("begin"), "parent")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = turns.join(begins, "conv").where("depth >= begin").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("begin"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), alone("conv")).otherwise(nobody).alias("ends_sha256"),
    )
    return shared.union(chains)


def conversation_trie(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """The trie of the rebuilt conversations. With texts, each node's role and text too (the root's are null)."""
    turns, convs = rebuild(conversations, ("role", "text") if texts else ())
    nodes = trie(turns, convs)
    if not texts:
        return nodes
    said = turns.select(F.col("conv").alias("conv_id"), "depth", F.coalesce("kept_role", F.lit("")).alias("role"), F.coalesce("kept_text", F.lit("")).alias("text"))
    return nodes.join(said, ["conv_id", "depth"], "left").select(*NODE, "role", "text")
