"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf: a digest of its columns. The leaves of a group (a language, say), in order, form a tree in which
`fanout` consecutive nodes become one; the groups' roots, in order, form the tree above. A superblock is fanout**levels
consecutive nodes: applyInPandas collapses that many levels of a superblock at once, the superblocks' roots are reduced
the same way, and so on. On the way back every superblock gets the proof of its own root from above, and each of its
nodes puts its part of the proof before that. A task holds one superblock, never a group; a round's superblocks are
written, so that lost executors cost no more than the round.

Digests are lower-case hexadecimal SHA-256 of concatenated texts. A node alone in its run is hashed alone; a group of one
leaf has that leaf as its root. Nulls are marked, so that they differ from empty texts; a null group is a group, the
first; rows of equal order are placed by their leaves, null order first. Repeated rows are leaves each. An empty table has
no rows. Texts are hashed whole, on the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import aside, materialize, number_in_order

FANOUT, LEVELS, DIGEST = 8, 3, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUTS = ("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified")

#: A step of a proof: a node's place in its run, and the digests of the others in it, joined.
Step = tuple[int, str]


def h(texts: Iterable[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """Digest of columns, each as its count of UTF-8 bytes, a colon and its value, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def height(n: int, fanout: int) -> int:
    """Levels until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def collapse(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level of a superblock, from the lowest."""
    out = [digests]
    for _ in range(levels):
        out.append([h(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(levels: list[list[str]], at: int, fanout: int) -> list[Step]:
    """The proof of a superblock's lowest node number `at` up to the superblock's root."""
    out = []
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        out.append((at - first, "".join(nodes[first:at] + nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(digest: str, proof: Iterable[Step]) -> str:
    """The root that a leaf and its proof lead to."""
    for place, others in proof:
        digest = h((others[: place * DIGEST], digest, others[place * DIGEST :]))
    return digest


def _pack(proof: list[Step]) -> str:
    return ";".join(f"{place}:{others}" for place, others in proof)


def _unpack(text: str) -> list[Step]:
    return [(int(place), others) for place, _, others in (s.partition(":") for s in text.split(";"))] if text else []


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Written tables (tree, place, n, digest) of the nodes that each round starts from; in the last, one a tree."""
    size, out = fanout**levels, [nodes]

    def reduced(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        n = int(block["n"].iloc[0])
        top = collapse(block["digest"].tolist(), min(levels, height(n, fanout)), fanout)[-1]
        return pd.DataFrame({"tree": block["tree"].iloc[:1].tolist(), "place": [block["place"].iloc[0] // size], "n": [-(-n // size)], "digest": top})

    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = out[-1].select("tree", "place", "n", "digest", F.floor(F.col("place") / size).alias("block")).groupBy("tree", "block")
        out.append(materialize(blocks.applyInPandas(reduced, "tree string, place long, n long, digest string")))
    return out


def _down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, carry: dict[str, str], leaves: str | None = None) -> DataFrame:
    """One step down: each node of a superblock with its tree's root and its own packed proof, which goes on with that
    of the superblock's root in `above` (tree, block, subroot, above).

    carry: columns of nodes that stay, and their names. leaves: schema of what a leaf gets instead of a packed proof.
    """
    size = fanout**levels

    def spread(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = collapse(block["digest"].to_pylist(), min(levels, height(block["n"][0].as_py(), fanout)), fanout)
        rest, subroot = _unpack(over["above"][0].as_py()), over["subroot"][0].as_py()
        proofs = [steps(tree, i, fanout) + rest for i in range(len(block))]
        out = {new: block[old] for old, new in carry.items()} | {"subroot": pa.array([subroot] * len(block), pa.string())}
        if leaves is None:
            return pa.table(out | {"above": pa.array(map(_pack, proofs), pa.string())})
        out["proof_sha256"] = pa.array([h(others for _, others in p) for p in proofs])
        out["folded_root"] = pa.array([fold(d, p) for d, p in zip(block["found"].to_pylist(), proofs)])
        if "proof array" in leaves:
            cut = lambda text: [text[i : i + DIGEST] for i in range(0, len(text), DIGEST)]
            kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
            out["proof"] = pa.array([[{"place": place, "siblings": cut(others)} for place, others in p] for p in proofs], kind)
        return pa.table(out)

    blocks = nodes.withColumn("block", F.floor(F.col("place") / size)).groupBy("tree", "block")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join((*(f"{new} {kinds[old]}" for old, new in carry.items()), "subroot string", leaves or "above string"))
    return blocks.cogroup(above.groupBy("tree", "block")).applyInArrow(spread, schema)


def _proved(tables: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, subroot, above) for the superblocks of the lowest round, from the same of the trees' roots."""
    for nodes in reversed(tables[1:-1]):
        above = materialize(_down(nodes, above, fanout, levels, {"tree": "tree", "place": "block"}))
    return above


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None, keep: tuple[str, ...] = ("doc_id",), proofs: bool = True, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: the `keep` columns, leaf, subroot (its group's root), root (of all), proof_sha256 (of all
    its siblings, from its own level up, left to right), folded_root (from the leaf of the `changed` values, where given,
    and the proof) and verified (folded_root is the root). With proofs, proof too: a level an item, the node's place in
    its run and its siblings.

    changed: expressions that take the place of columns in the leaf that is checked, as in a later copy of the data.
    A kept column that is named like an output comes out as kept_ and its name.
    """
    names = aside(docs.select(*keep), *OUTPUTS).columns
    given = {c: F.col(f"`{c}`") for c in columns}
    kept = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(name.alias("tree"), F.col(f"`{order}`").alias("by"), leaf_of(*given.values()).alias("digest"), leaf_of(*(given | (changed or {})).values()).alias("found"), kept.alias("kept"))
    leaves = materialize(number_in_order(materialize(rows), ["tree"], ["by", "digest"]))
    tables = _climb(leaves, fanout, levels)
    named = materialize(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"))
    roots = materialize(number_in_order(named, ["tree"], ["own"]))
    upper = _climb(roots, fanout, levels)
    root = upper[-1].select("digest").first()  # one row, or none for an empty table
    top = upper[-1].select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), F.lit("").alias("above"))
    of_roots = _down(roots, _proved(upper, top, fanout, levels), fanout, levels, {"own": "tree", "digest": "own_digest"})
    start = materialize(of_roots.select("tree", F.lit(0).cast("long").alias("block"), F.col("own_digest").alias("subroot"), "above"))
    leaf = "proof_sha256 string, folded_root string" + ", proof array<struct<place: int, siblings: array<string>>>" * proofs
    out = _down(leaves, _proved(tables, start, fanout, levels), fanout, levels, {"kept": "kept", "digest": "leaf"}, leaf)
    out = out.withColumn("root", F.lit(root and root["digest"]).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select(*(F.col(f"kept.`{n}`") for n in names), *(c for c in OUTPUTS if c != "proof" or proofs))
