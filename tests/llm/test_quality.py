import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from goldrec.llm import quality
from goldrec.llm.words import runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def measures(text):
    """The labellers' measures, word by word."""
    raw = text.encode()
    words = WORD.findall(raw)
    capital, small = lambda b: 65 <= b < 91, lambda b: 97 <= b < 123 or b >= 128
    mark = lambda b: not (capital(b) or small(b) or 48 <= b < 58)
    letters, n = sum(capital(b) or small(b) for b in raw), max(1, len(words))
    return {
        "capitals": sum(map(capital, raw)) / max(1, letters),
        "doubled_marks": sum(len(w) > 1 and mark(w[-1]) and w[-1] == w[-2] for w in words) / n,
        "bare_marks": sum(all(map(mark, w)) for w in words) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "few_letters": 1 - letters / max(1, sum(map(len, words))),
        "no_stops": 1 - sum(w[-1] in b".," for w in words) / n,
    }, len(words)


def test_measures_and_decisions_against_brute_force(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    texts = [r["text"] or "" for r in docs.collect()]
    patterns = collections.Counter()
    for text in texts:
        (_, flat, at), = runs(pa.array([text]))
        seen, (want, n) = quality.Measures(flat, at), measures(text)
        assert {k: pytest.approx(v[0]) for k, v in seen.values.items()} == want and seen.n[0] == n
        votes = [n >= quality.FEW and all(low <= want[m] < high for m, (low, high) in needs.items()) for _, needs in quality.LABELLERS.values()]
        assert seen.pattern()[0] == sum(v << k for k, v in enumerate(votes))
        patterns[int(seen.pattern()[0])] += 1
    weights = quality.train(docs)
    kept = collections.Counter()
    for r in docs.collect():  # one at a time, unlike the operator
        (_, flat, at), = runs(pa.array([r["text"] or ""]))
        seen = quality.Measures(flat, at)
        z = sum(weights[f] for f in seen.feature) / max(1, len(seen.feature)) + weights[-1]
        if not seen.n[0] or 1 / (1 + np.exp(z)) >= 0.5:
            kept[r["doc_id"]] += 1
    assert kept == collections.Counter(r["doc_id"] for r in quality.keep_clean(docs, columns=("doc_id",)).collect())


def test_repeated_rows_never_empty_the_sample(spark):
    junk = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("BUY NOW!! CHEAP PILLS!! CLICK HERE!! WIN BIG!! ACT FAST!!").alias("text"))
    assert quality.train(junk).any() and quality.keep_clean(junk).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    both = docs.union(junk.selectExpr("doc_id + 1000000", "text"))
    kept = {r["doc_id"] for r in quality.keep_clean(both, columns=("doc_id",)).collect()}
    alone = {r["doc_id"] for r in quality.keep_clean(docs, columns=("doc_id",)).collect()}
    assert not any(k >= 1000000 for k in kept) and len(kept ^ alone) <= 0.02 * len(alone)


def test_sample_is_bounded_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a, b = quality.train(docs, sample=50), quality.train(docs.repartition(7).orderBy("text"), sample=50)
    assert a.any() and np.allclose(a, b) and not np.allclose(a, quality.train(docs))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_against_labels(spark, sf):
    """Labels are never seen in training: held-out accuracy."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    kept = {r["doc_id"] for r in quality.keep_clean(docs, columns=("doc_id",)).collect()}
    seen = collections.Counter((r["quality"], r["doc_id"] in kept) for r in labels.collect())
    assert seen[(1, False)] == 0
    assert seen[(0, True)] <= 0.02 * (seen[(0, True)] + seen[(0, False)])


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(200_000) < 0.3
    says = np.array([vote for vote, _ in quality.LABELLERS.values()], bool)
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.95, 0.9, 0.97])
    # A labeller with one vote gives it to its class at rate c and to the other as often as makes it right `right` of the time.
    inside = np.where(says, truth.mean(), 1 - truth.mean())
    other = 0.6 * inside * (1 - right) / right / (1 - inside)
    votes = rng.random((200_000, 8)) < np.where(truth[:, None] == says, 0.6, other)
    patterns = (votes << np.arange(8)).sum(1)
    junk, found, share = quality.estimate(dict(collections.Counter(patterns.tolist())))
    assert abs(share - 0.3) < 0.06 and np.abs(found - right).max() < 0.06
    assert np.mean((np.array([junk[p] for p in patterns.tolist()]) > 0.5) == truth) > 0.94


def test_odd_rows(spark, odd, nothing):
    kept = quality.keep_clean(odd)
    assert kept.columns == [*odd.columns, "quality"]
    rows = kept.collect()
    assert sum(r["quality"] is None for r in rows) == 4
    assert {0, 1, 2}.issubset({r["doc_id"] for r in rows})
    clash = quality.keep_clean(odd.withColumn("quality", F.lit("mine")))
    assert clash.columns == [*odd.columns, "kept_quality", "quality"] and all(r["kept_quality"] == "mine" for r in clash.collect())
    whole = odd.withColumn("quality", F.lit("mine")).withColumn("score", F.lit("too"))
    bare = quality.keep_clean(whole, out=None)
    assert bare.columns == whole.columns and all((r["quality"], r["score"]) == ("mine", "too") for r in bare.collect())
    assert quality.keep_clean(nothing).collect() == [] and quality.keep_clean(nothing).columns == [*nothing.columns, "quality"]


def test_each_pass_makes_only_what_it_needs():
    """Labellers look at shares, the scorer at shapes: neither pass makes the other's, and the sample's shapes are its own."""
    texts = ["One two, two three.", "", "ABC!! 12ab éa one", "a b c d e f"]
    (_, flat, at), = runs(pa.array(texts))
    seen = quality.Measures(flat, at)
    seen.pattern()
    assert "feature" not in vars(seen)
    doc, feature, value = seen.of(np.array([0, 2])).features()
    assert "feature" not in vars(seen)
    whole = [x[np.isin(seen.features()[0], [0, 2])] for x in seen.features()]
    assert feature.tolist() == whole[1].tolist() and value.tolist() == whole[2].tolist() and (2 * doc).tolist() == whole[0].tolist()
    scored = quality.Measures(flat, at)
    assert len(scored.feature) and "values" not in vars(scored)
