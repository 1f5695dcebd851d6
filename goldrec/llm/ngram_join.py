"""Near-duplicate join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets form one class, so copies are never paired. Classes are searched with forests of count-vector R-trees:

1. Routing. A class enters the trees of its first n - ceil(0.8 n) + 1 shingles in an order common to all; two classes
   that link share one of them, whatever the order. The first that they share is among the first n - ceil(8 n / 9) + 1 of
   the smaller one; a tree where no class is of that kind, or only larger ones are, is left out, and pairs meet only
   where the smaller one is. Shingles that recur within batches of documents come last in the order, which keeps trees
   small; that set only orders the shingles and can lose no link.
2. Points. Shingles are hashed into groups, more of them for larger sets, and the groups' counts are a class's point.
   The overlap of two classes is at most the sum over coordinates of the smaller count; with the sizes this bounds the
   similarity. Points fold into fewer groups by adding counts up, so classes of any two sizes can be compared.
3. Stars. In each tree one class is the pivot; each class meets the pivot that it shares most trees with. If their
   bound reaches the threshold, the pair is verified. Most groups of near copies are one component after this, and
   pairs inside a component need no look.
4. Trees. Of the trees that still hold several components, those with equal members count once. Points folded to GROUPS
   coordinates are packed into an R-tree, whose nodes hold maxima. A tree of one node is scanned; a large tree is cut
   into blocks that meet as a grid, so no task holds more than two blocks. Pairs of larger sets are bounded once more by
   their whole points. The pairs that survive stay in the task: it tells of each class with a partner only which group
   of survivors it belongs to, at most a row a class and tree.
5. Verification. Classes that survivors join, over all trees, form a cluster; every link lies inside one. A cluster's
   sets come together once (a large one's in blocks that meet as a grid), their overlaps are counted from an inverted
   index, and the links that join different components are told, fewer than there are classes in the task. A cluster
   of near misses thus costs time in a task but no rows.
6. Links become components.

Words are lower-cased in A to Z. A text with fewer than five words has its whole sequence as one shingle; one without
words (or null) is linked with nothing. A row without an id is in no component (null). Rows that repeat an id are
placed by their own texts. Classes and shingles are told apart by 64-bit hashes: of n classes, two clash with a chance
of n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import WORD, broadcast_if_small, components, materialize, release
from goldrec.llm.words import Sequences, Words, mix, runs, signed, slices

SHINGLE, PERCENT = 5, 80
#: Shingles that a batch of documents holds this often are candidates for the common ones, of which there are at most
#: COMMON_MOST (each is counted COMMON_LEAST times or more).
BATCH_LEAST, COMMON_LEAST, COMMON_MOST = 4, 64, 500_000
#: Groups that shingles are counted in at least, shingles of a group at most (larger sets get more groups, by doubling),
#: entries of an R-tree node, classes of a tree's block, shingles of a cluster's block.
GROUPS, PER_GROUP, FANOUT, BLOCK, CLUSTER_SHINGLES = 128, 4, 16, 1024, 1 << 19
#: The largest count that a point's byte holds; it stands for itself and all that are larger.
MANY = 255


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of some rows, their offsets) over an Arrow column."""
    for first, flat, at in runs(texts):
        words = Words(flat, at, lower=True)
        hashes = words.hashes()
        per_doc = np.where(words.counts >= size, words.counts - size + 1, (words.counts > 0).astype(int))
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + words.first[:-1][doc]
        grams = Sequences(hashes).of(begin, np.minimum(begin + size, words.first[1:][doc]))
        edges = np.concatenate([[0], np.cumsum(per_doc)])
        for k in np.flatnonzero(per_doc > 1).tolist():  # a document at a time, in place: several times faster than by two keys
            grams[edges[k] : edges[k + 1]].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[new], grams[new]
        yield first, grams, np.searchsorted(doc, np.arange(len(per_doc) + 1))


def set_hashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set: the sum of its mixed members."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ (at[1:] - at[:-1]).astype(np.uint64))


def points(grams: np.ndarray, at: np.ndarray) -> pa.Array:
    """A byte per group and set: how many of its shingles fall into the group, MANY at most."""
    sizes = np.diff(at)
    groups = GROUPS << np.ceil(np.log2(np.maximum(sizes / (GROUPS * PER_GROUP), 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(groups)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[doc] + (grams & (groups[doc] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=begin[-1]), MANY).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(counts)]).cast(pa.binary())


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups."""
    if len(point) == groups:
        return point
    sums = point.reshape(-1, groups).astype(np.int64)
    return np.minimum(np.where(sums == MANY, 1 << 32, sums).sum(0), MANY).astype(np.uint8)


def may_link(least: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Do rows of smaller counts, with the sums of both sizes, reach the threshold? Where both are MANY, they may."""
    good = (100 + PERCENT) * least.sum(1, dtype=np.int64) >= PERCENT * n
    return good | (least == MANY).any(1) if least.max(initial=0) == MANY else good


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (kind 0: id, text hash, set size, class, point) and per shingle that recurs (kind 1: it, its count)."""
    names = ["kind", "doc_id", "text_hash", "n", "node", "point"]
    for batch in batches:
        first = 0
        own: list[np.ndarray] = []
        seen: set[int] = set()
        for _, grams, at in shingle_sets(batch.column(2)):
            size, sizes, nodes = len(at) - 1, np.diff(at), set_hashes(grams, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int32)), *(batch.column(c).slice(first, size) for c in (0, 1)), pa.array(sizes.astype(np.int64)), pa.array(signed(nodes)), points(grams, at)], names=names)
            for i, node in enumerate(nodes.tolist()):  # copies count once
                if node not in seen:
                    seen.add(node)
                    own.append(grams[at[i] : at[i + 1]])
            first += size
        found, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        found, counts = found[counts >= BATCH_LEAST], counts[counts >= BATCH_LEAST]
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, none, pa.array(counts.astype(np.int64)), pa.array(signed(found)), pa.nulls(len(found), pa.binary())], names=names)


def _late_last(grams: np.ndarray, late: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of each set, sorted as they are, with those marked late behind the others; and the marks."""
    before = np.concatenate([[0], np.cumsum(late)])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    passed = before[:-1] - before[at[:-1]][doc]  # late ones of the set that come before
    rest = before[at[1:]][doc] - before[:-1]  # and those that don't
    place = np.arange(len(grams)) - passed
    place[late] = (at[1:][doc] - rest)[late]
    out, marks = np.empty_like(grams), np.empty_like(late)
    out[place], marks[place] = grams, late
    return out, marks


def prefixes(docs: DataFrame, common: np.ndarray, text: str) -> DataFrame:
    """(token, node, n, rare, early): each class in the trees that it is routed to; rare counts its uncommon routing
    shingles; early: may this be the first shingle that it shares with a class of its size or more?"""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for _, grams, at in shingle_sets(batch.column(0)):
                nodes, sizes = set_hashes(grams, at), np.diff(at)
                own = np.zeros(len(nodes), bool)
                own[np.unique(nodes, return_index=True)[1]] = True
                own &= sizes > 0
                doc = np.repeat(np.arange(len(sizes)), sizes)
                late = np.zeros(len(grams), bool)
                if len(table):
                    place = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                    late = table[place] == grams
                grams, late = _late_last(grams, late, at)
                length = sizes - -(-PERCENT * sizes // 100) + 1
                place = np.arange(len(grams)) - at[:-1][doc]
                chosen = own[doc] & (place < length[doc])
                early = (place < (sizes - -(-2 * PERCENT * sizes // (100 + PERCENT)) + 1)[doc])[chosen]
                doc = doc[chosen]
                rare = np.bincount(doc, ~late[chosen], len(sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[chosen])), pa.array(signed(nodes)[doc]), pa.array(sizes[doc].astype(np.int32)), pa.array(rare[doc]), pa.array(early)], names=["token", "node", "n", "rare", "early"])

    return docs.select(text).mapInArrow(over, "token long, node long, n int, rare int, early boolean")


def _bounded(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole points let them link; known has node, n and point."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            total = (batch.column(2).to_numpy() + batch.column(4).to_numpy()).astype(np.int64)
            for k, (x, y) in enumerate(zip(batch.column(3), batch.column(5))):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                groups = min(len(x), len(y))
                good[k] = may_link(np.minimum(fold(x, groups), fold(y, groups))[None], total[k : k + 1])[0]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (0, 1)], names=["a", "b"])

    sides = [known.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("point").alias(f"_p{x}")) for x in "ab"]
    near = "(100 * least(_na, _nb) >= %d * greatest(_na, _nb))" % PERCENT
    return pairs.join(sides[0], "a").join(sides[1], "b").where(near).select("a", "b", "_na", "_pa", "_nb", "_pb").mapInArrow(over, "a long, b long")


CELL = ["cluster", "i", "j"]


def _verified(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between classes of different components, as many as join what links in a cell join, and
    (node, null, n) with the number of a class's links in a cell if its component is null (then all pairs are told of).

    `cells` (cluster, i, j, node, chunk, component): in a cell, the classes of chunk i meet those of chunk j. A cell's
    sets must fit a task.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in (part for whole in batches for part in slices(whole, 6)):
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            node, chunk, component = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
            for first, grams, at in shingle_sets(batch.column(6)):
                for k in range(len(at) - 1):
                    key = tuple(keys[first + k].tolist())
                    if key != last and held:
                        yield from _cell_links(last, held)
                        held = []
                    last = key
                    held.append((node[first + k], chunk[first + k], component[first + k], grams[at[k] : at[k + 1]].copy()))
        if held:
            yield from _cell_links(last, held)

    met = cells.join(texts, "node").select(*CELL, "node", "chunk", "component", "text")
    return met.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(over, "a long, b long, n long")


def _cell_links(key: tuple[int, int, int], held: list[tuple[int, int, int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    _, i, j = key
    node, chunk = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
    counting = held[0][2] is None
    label = node.copy() if counting else np.array([h[2] for h in held], np.int64)
    sizes = np.array([len(h[3]) for h in held], np.int64)
    _, gram, times = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.repeat(np.arange(len(held)), sizes)[np.argsort(gram, kind="stable")]  # the sets that hold each shingle
    begin = np.concatenate([[0], np.cumsum(times)])
    told: list[tuple[int, int | None, int]] = []
    number = np.zeros(len(held), np.int64)
    for q in np.flatnonzero(chunk == i).tolist():
        if not counting and (label == label[q]).all():
            break
        own = gram[at[q] : at[q + 1]]
        own = own[times[own] > 1]
        much = times[own]
        places = np.arange(int(much.sum())) + np.repeat(begin[own] - (np.cumsum(much) - much), much)
        both = np.bincount(docs[places], minlength=len(held))
        good = (100 * both >= PERCENT * (sizes[q] + sizes - both)) & (chunk == j)
        if counting:
            good[: q + 1] &= i != j
            number[q] += good.sum()
            number += good
        hits = np.flatnonzero(good & (label != label[q]))
        if len(hits):
            found, first = np.unique(label[hits], return_index=True)
            told += [(int(node[q]), int(node[hits[f]]), 0) for f in first]
            label[np.isin(label, found)] = label[q]
    told += [(int(node[k]), None, int(number[k])) for k in np.flatnonzero(number)]
    if told:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*told)], names=["a", "b", "n"])


def _texts(nodes: DataFrame, known: DataFrame, hashed: DataFrame) -> DataFrame:
    """(node, text) of some classes; known (node, doc_id, text_hash, ...) is a written table."""
    asked = materialize(known.select("node", "doc_id", "text_hash").join(nodes, "node", "left_semi"))
    return materialize(hashed.join(broadcast_if_small(asked), ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))


def _star_links(stars: DataFrame, known: DataFrame, hashed: DataFrame) -> DataFrame:
    """The pairs (node, pivot) that link: each pivot meets its classes block by block."""
    sizes = stars.join(known.select("node", "n"), "node")
    blocks = sizes.groupBy("pivot").agg(F.ceil(F.sum("n") / CLUSTER_SHINGLES).alias("_blocks"))
    members = materialize(sizes.join(blocks, "pivot").select(F.col("pivot").alias("cluster"), "node", F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("chunk")))
    pivots = members.select("cluster", F.col("cluster").alias("node"), F.lit(-1).cast("long").alias("chunk"), F.col("chunk").alias("j")).distinct()
    cells = members.withColumn("j", F.col("chunk")).unionByName(pivots).select("cluster", F.lit(-1).cast("long").alias("i"), "j", "node", "chunk", F.col("node").alias("component"))
    texts = _texts(members.select("node").union(members.select("cluster")).distinct(), known, hashed)
    found = materialize(_verified(materialize(cells), texts).select("a", "b"))
    release(texts)
    return found


def _grid(rows: DataFrame) -> DataFrame:
    """rows (with _blocks, the number of blocks that their group is cut into) with chunk, i and j: in each cell that two
    blocks share, or one has to itself."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    met = dealt.withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    return met.withColumn("i", F.least("chunk", "_other")).withColumn("j", F.greatest("chunk", "_other")).drop("_other", "_blocks")


class RTree:
    """Points packed by size and then by their fullest coordinate into nodes of FANOUT; nodes into one level above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low = self.points, self.sizes
        while len(low) > FANOUT:
            cuts = np.arange(0, len(low), FANOUT)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all pairs whose bound reaches the threshold, some queries at a time."""
        step = max(1, (1 << 16) // len(self.sizes))
        top = len(self.levels[-1][1] if self.levels else self.sizes)
        for first in range(0, len(sizes), step):
            queries = np.arange(first, min(first + step, len(sizes)))
            asked, at = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
            for k in range(len(self.levels) - 1, -1, -1):
                high, low = self.levels[k]
                good = self._reach(high[at], low[at], points[asked], sizes[asked])
                asked, at = np.repeat(asked[good], FANOUT), (at[good][:, None] * FANOUT + np.arange(FANOUT)).ravel()
                good = at < len(self.levels[k - 1][1] if k else self.sizes)
                asked, at = asked[good], at[good]
            good = self._reach(self.points[at], self.sizes[at], points[asked], sizes[asked])
            yield asked[good], self.order[at[good]]

    @staticmethod
    def _reach(high: np.ndarray, low: np.ndarray, point: np.ndarray, size: np.ndarray) -> np.ndarray:
        return may_link(np.minimum(high, point), low.astype(np.int64) + size)


def _survivors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root): each class with a partner of another component whose bound reaches the threshold, and the first
    class of its group of survivors in the tree; rows come sorted by their tree."""
    keys, rest = ["token", "i", "j"], None
    for frame in frames:
        frame = pd.concat([rest, frame], ignore_index=True) if rest is not None and len(rest) else frame
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        rest = frame.iloc[cuts[-1] if len(cuts) else 0 :]
        if len(cuts):
            yield _groups(frame.iloc[: cuts[-1]], [0, *cuts.tolist()])
    if rest is not None and len(rest):
        yield _groups(rest, [0, len(rest)])


def _groups(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
    node, n, comp, chunk, i, j, early = (frame[c].to_numpy() for c in ("node", "n", "component", "chunk", "i", "j", "early"))
    points = frame["point"].to_numpy()
    wide = np.fromiter(map(len, points), np.int64, len(points))
    whole = {int(k): np.frombuffer(points[k], np.uint8) for k in np.flatnonzero(wide > GROUPS)}
    counts = np.empty((len(points), GROUPS), np.uint8)
    counts[wide == GROUPS] = np.frombuffer(b"".join(points[wide == GROUPS]), np.uint8).reshape(-1, GROUPS)
    for k, point in whole.items():
        counts[k] = fold(point, GROUPS)
    levels, groups = {}, 2 * GROUPS
    while whole and groups <= wide.max():
        rows = np.flatnonzero(wide >= groups)
        row = np.zeros(len(points), np.int64)
        row[rows] = np.arange(len(rows))
        levels[groups] = row, np.stack([fold(whole[int(k)], groups) for k in rows])
        groups *= 2

    def first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """May this be the first tree that both share?"""
        return np.where(n[x] < n[y], early[x], np.where(n[x] > n[y], early[y], early[x] | early[y]))

    def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Does the bound reach the threshold at every finer grouping that both points have?"""
        good = np.ones(len(x), bool)
        for groups, (row, finer) in levels.items():
            some = np.flatnonzero(good & (wide[x] >= groups) & (wide[y] >= groups))
            for low in range(0, len(some), (1 << 21) // groups + 1):
                k = some[low : low + (1 << 21) // groups + 1]
                good[k] = may_link(np.minimum(finer[row[x[k]]], finer[row[y[k]]]), n[x[k]].astype(np.int64) + n[y[k]])
        return good

    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    root = np.arange(len(frame))

    def pairs(x: np.ndarray, y: np.ndarray) -> None:
        met = (comp[x] != comp[y]) & (chunk[y] == j[x]) & first(x, y)
        x, y = x[met], y[met]
        met = reach(x, y)
        _join(root, x[met], y[met])

    # Trees of one node, many at a time: their entries are scanned.
    for step in range(1, FANOUT):
        x = np.flatnonzero((group[step:] == group[:-step]) & (sizes[group[step:]] <= FANOUT))
        y = x + step
        met = (comp[x] != comp[y]) & ((i[x] == j[x]) | (chunk[x] != chunk[y]))
        met &= (100 * np.minimum(n[x], n[y]).astype(np.int64) >= PERCENT * np.maximum(n[x], n[y])) & first(x, y)
        x, y = x[met], y[met]
        for low in range(0, len(x), 1 << 14):
            u, v = x[low : low + (1 << 14)], y[low : low + (1 << 14)]
            good = may_link(np.minimum(counts[u], counts[v]), n[u].astype(np.int64) + n[v])
            u, v = u[good], v[good]
            good = reach(u, v)
            _join(root, u[good], v[good])
    for k in np.flatnonzero(sizes > FANOUT):
        low, high = cuts[k], cuts[k + 1]
        if (comp[low:high] == comp[low]).all():
            continue
        own = low + np.flatnonzero(chunk[low:high] == i[low:high])  # in a cell of two blocks, the first asks the second
        for asked, row in RTree(counts[low:high], n[low:high]).search(counts[own], n[own]):
            pairs(own[asked], low + row)
    while (root != root[root]).any():
        root = root[root]
    alive = root != np.arange(len(root))
    return pd.DataFrame({"node": node[alive], "root": node[root[alive]]}).drop_duplicates()


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Brings x and y under one root, pair by pair; roots are never larger than what they stand for."""
    while len(x):
        while True:
            x, y = root[x], root[y]
            if (root[x] == x).all() and (root[y] == y).all():
                break
        apart = x != y
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(root, y, x)


def near_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", links: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id and text_hash (to tell rows of one id apart).

    links: also class_id (the smallest id of an equal set) and n_links, the number of other classes that the class
    links with. All links are then counted, so that no pair is passed over for being in one component already.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    hashed = slim.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scanned = materialize(hashed.mapInArrow(_scan, "kind int, doc_id long, text_hash long, n long, node long, point binary"))
    documents = scanned.where("kind = 0").drop("kind", "point")
    counted = materialize(scanned.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST))
    least = max(COMMON_LEAST, -(-(counted.agg(F.sum("n")).first()[0] or 0) // COMMON_MOST))
    common = np.sort(np.array([r[0] for r in counted.where(F.col("n") >= least).select("node").collect()], np.int64).view(np.uint64))  # at most COMMON_MOST

    routed = materialize(prefixes(slim, common, "text"))
    several = routed.groupBy("token").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.min(F.when(F.col("early"), F.col("n"))).alias("_least"))
    several = materialize(several.where("_lo <> _hi AND _least IS NOT NULL").select("token", "_least"))
    met = materialize(routed.join(several, "token").where("early OR n >= _least").drop("_least").distinct())
    release(routed)
    classes = materialize(documents.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min_by("text_hash", "doc_id").alias("text_hash")))
    asked = classes.join(met.select("node").distinct(), "node").select("node", F.col("first_id").alias("doc_id"), "text_hash")
    known = materialize(scanned.where("kind = 0").drop("kind").join(asked, ["node", "doc_id", "text_hash"]).dropDuplicates(["node"]))

    own = F.col("node")
    near, parts = None, None
    if not links:
        pivots = met.groupBy("token").agg(F.min_by("node", F.col("rare").cast("long") * (1 << 32) + F.pmod(own, F.lit(1 << 32))).alias("pivot"))
        stars = met.join(materialize(pivots), "token").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("_n"))
        stars = materialize(stars.groupBy(own.alias("a")).agg(F.max_by("pivot", F.struct("_n", "pivot")).alias("b")))
        near = _star_links(materialize(_bounded(stars, known)).toDF("node", "pivot"), known, hashed)
        parts = components(near, "a", "b")

    def placed(rows: DataFrame) -> DataFrame:
        """rows with the component of their class; one of its own until stars have found another."""
        return rows.withColumn("component", own) if links else rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", own))

    placings = materialize(placed(met.select("token", "node", "n", "early")))
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node", "early")).alias(f"_s{k}") for k in (0, 1)]
    trees = placings.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_rows"), *members).where("_lo <> _hi")
    trees = materialize(trees.groupBy("_rows", "_s0", "_s1").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("_rows") / BLOCK).alias("_blocks")))
    cells = _grid(placings.join(trees, "token")).join(known.select("node", "point"), "node")
    sorted_trees = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    survivors = materialize(sorted_trees.mapInPandas(_survivors, "node long, root long").distinct())

    clusters = components(survivors, "node", "root").withColumnRenamed("component", "cluster").join(known.select("node", "n"), "node")
    clusters = materialize(clusters.withColumn("component", F.lit(None).cast("long")) if links else placed(clusters))
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER_SHINGLES).alias("_blocks"))
    texts = _texts(clusters.select("node"), known, hashed)
    found = materialize(_verified(materialize(_grid(clusters.join(blocks, "cluster"))), texts))
    release(texts)
    more = found.where("b IS NOT NULL").select("a", "b")

    ids = classes.select("node", "first_id")
    joined = (more if near is None else near.union(more)).join(ids.select(F.col("node").alias("a"), F.col("first_id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("first_id").alias("y")), "b").select("x", "y")
    grouped = components(joined, "x", "y").withColumnRenamed("node", "first_id")
    of_class = ids.join(grouped, "first_id", "left").select("node", F.col("first_id").alias("class_id"), F.coalesce("component", "first_id").alias("component_id"))
    if links:
        of_class = of_class.join(found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    more = [F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return documents.join(materialize(of_class), "node", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component, *more, "text_hash")


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of its smallest id. Rows without an id or without words all stay.

    Repeated rows of the kept id with the same text are copies, of which one stays. All columns come out as they were,
    whatever their names.
    """
    found = near_components(docs, text, id_col)
    kept = found.where((F.col("component_id") == F.col(id_col)) & (F.col("n_shingles") > 0)).select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("words"))
    one = whole.where("id IS NOT NULL AND words").join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return one.select("row").union(whole.where("id IS NULL OR NOT words").select("row")).select("row.*")
