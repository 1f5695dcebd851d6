import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldrec.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Components over rows (id, text) by trying all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in ngram_join.near_components(frame).collect())
    assert got == brute(rows)
    return got


def family(rng, base, size, edits, words):
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            copy[rng.integers(len(copy))] = words[rng.integers(len(words))]
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_families(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 8)
    monkeypatch.setattr(ngram_join, "CLUSTER_SHINGLES", 1 << 19 if block > 8 else 2000)
    rng = np.random.default_rng(block)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "a", "A", "a b c", "a b c", "x y z"]
    for size in (3, 40, 2, 120):
        texts += family(rng, [words[i] for i in rng.integers(0, 3000, rng.integers(30, 120))], size, 6, words)
    shared = " ".join(words[:40])
    texts += [shared + " " + " ".join(words[i] for i in rng.integers(0, 3000, 40)) for _ in range(50)]
    base = rng.integers(0, 3000, 100)  # near misses of each other: a hundred words shared, as many as 20 own
    texts += [" ".join([words[i] for i in base] + [f"own{k}_{i}" for i in range(rng.integers(16, 21))]) for k in range(300)]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    got = check(spark, rows)
    assert len({c for _, _, c in got}) < len(got)
    check_links(spark, rows)


def check_links(spark, rows):
    """class_id and n_links of every document by trying all pairs."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for doc, text in sorted(rows):
        first.setdefault(shingles(text), doc)
    sets = [s for s in first if s]
    where, links = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for j, both in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links.update((s, sets[j]))
        for x in s:
            where[x].append(i)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_components(frame, links=True).collect()}
    assert got == {doc: (first[shingles(text)] if shingles(text) else doc, links[shingles(text)]) for doc, text in rows}


def test_corpus(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_odd_rows(spark, odd, nothing):
    got = ngram_join.near_components(odd).collect()
    assert len(got) == odd.count()
    by = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert by[(None, 1, None)] == 1 and by[(None, 0, None)] == 1 and by[(3, 1, 3)] == 2 and by[(0, 0, 0)] == 1
    assert all((100 + i, 4, 100) in by for i in range(40))
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[None] == 2 and ids[3] == 1 and ids[4] == 2 and ids[0] == 1 and sum(i is not None and i >= 100 for i in ids) == 1
    for name in ("_words", "_text_hash", "words", "hash", "row", "id", "component_id", "n_shingles", "text_hash"):
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    clash = ngram_join.keep_first(odd)
    assert clash.columns == odd.columns and collections.Counter(r["doc_id"] for r in clash.collect()) == ids
    assert all(r["row"] == "own row" and r["_words"] == "own _words" for r in clash.collect())
    assert ngram_join.near_components(nothing).collect() == [] and ngram_join.keep_first(nothing).collect() == []


def test_tree_finds_all_above_the_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (700, ngram_join.GROUPS)).astype(np.uint16)
    points[300:] = np.maximum(0, points[rng.integers(0, 300, 400)].astype(int) + rng.integers(-1, 2, (400, ngram_join.GROUPS)) * (rng.random((400, 1)) < 0.5))
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_join.RTree(points, sizes)
    for q in range(0, 700, 13):
        want = np.flatnonzero(180 * np.minimum(points, points[q]).sum(1, dtype=np.int64) >= 80 * (sizes + sizes[q]))
        assert sorted(row for _, rows in tree.search(points[q : q + 1], sizes[q : q + 1]) for row in rows) == want.tolist()
