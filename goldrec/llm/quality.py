"""Quality classifier from weak labels: overlapping heuristic labellers vote, expectation-maximisation finds how far each
can be trusted, and the posterior labels train a hashed linear scorer, which decides.

1. One pass measures, per document, what eight labellers look at; each votes (junk or clean, its own) or abstains. The
   votes form a pattern; patterns (at most 2**8) are counted over all different texts.
2. EM over the pattern counts estimates the share of junk and how often each labeller is right.
3. Features are shares of hashed word shapes: runs of capitals, other letters and digits as one mark each, other bytes
   as they are, and whether a word repeats the one before. A logistic model over them is fitted to the posteriors of a
   sample of different texts, SAMPLE at most: texts are dealt into SAMPLE parts by a hash, and the least hash of each
   part is taken. The sample is even at any size of the corpus, and repeated texts count once in it.
4. A second pass scores every document; it is kept if clean is at least as likely as junk.

A text without words (empty, null) gives no evidence and is kept, with a null score. Repeated rows get equal scores.
An empty table trains nothing and returns no rows. A column named like the score comes out as kept_ and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import aside, fresh, materialize
from goldrec.llm.words import Words, mix, powers, runs, slices

#: Texts that the scorer is fitted to at most; size of its hashed feature space.
SAMPLE, FEATURES = 20_000, 4096
#: Labeller: its vote (1 junk, 0 clean) where every measure named lies from the first bound to below the second; else it
#: abstains. Each kind of junk has labellers of its own, and those that vote clean overlap.
LABELLERS = {
    "shouting": (1, {"capitals": (0.4, 2)}),
    "marked": (1, {"doubled_marks": (0.2, 2)}),
    "listed": (1, {"bare_marks": (0.2, 2)}),
    "repeating": (1, {"repeats": (0.3, 2)}),
    "unlettered": (1, {"few_letters": (0.35, 2)}),
    "stopped": (0, {"no_stops": (0, 0.98), "bare_marks": (0, 0.05), "repeats": (0, 0.1), "doubled_marks": (0, 0.05)}),
    "cased": (0, {"capitals": (0, 0.15), "bare_marks": (0, 0.05), "repeats": (0, 0.1), "doubled_marks": (0, 0.05)}),
    "lettered": (0, {"few_letters": (0, 0.2), "capitals": (0, 0.3), "bare_marks": (0, 0.1), "repeats": (0, 0.2), "doubled_marks": (0, 0.1)}),
}
#: Documents with fewer words than this get no votes on shares of words.
FEW = 5

CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[128:], CLASSES[48:58] = 65, 97, 97, 48
MARK = np.ones(256, bool)
MARK[65:91] = MARK[97:123] = MARK[128:] = MARK[48:58] = False


class Measures:
    """What the labellers (values) and the scorer (feature) see of some texts, each made when it is first asked for."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.words, self.at = Words(flat, at), at
        self.n = self.words.counts
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        hashes = self.words.hashes()
        self.same = np.zeros(len(hashes), bool)
        self.same[1:] = (hashes[1:] == hashes[:-1]) & (self.doc[1:] == self.doc[:-1])

    @cached_property
    def values(self) -> dict[str, np.ndarray]:
        flat, at, doc, starts, ends = self.words.flat, self.at, self.doc, self.words.starts, self.words.ends
        share = lambda which: np.bincount(doc, which, len(self.n)) / np.maximum(self.n, 1)
        last = flat[ends - 1]
        doubled = MARK[last] & (ends - starts > 1) & (flat[np.maximum(ends - 2, 0)] == last)
        sums = lambda table: np.concatenate([[0], np.cumsum(table[flat])])
        marks, capitals, small = sums(MARK), sums(CLASSES == 65), sums(CLASSES == 97)
        span = lambda total, low, high: (total[high] - total[low]).astype(float)
        letters = span(capitals, at[:-1], at[1:]) + span(small, at[:-1], at[1:])
        inside = np.bincount(doc, ends - starts, len(self.n))
        return {
            "capitals": span(capitals, at[:-1], at[1:]) / np.maximum(letters, 1),
            "doubled_marks": share(doubled),
            "bare_marks": share(span(marks, starts, ends) == ends - starts),
            "repeats": share(self.same),
            "few_letters": 1 - letters / np.maximum(inside, 1),
            "no_stops": 1 - share((last == 46) | (last == 44)),
        }

    @cached_property
    def feature(self) -> np.ndarray:
        """Shapes: a polynomial over the first bytes of each run of equal classes in a word."""
        flat, starts, ends = self.words.flat, self.words.starts, self.words.ends
        classes = CLASSES[flat]
        new = np.ones(len(flat), bool)
        new[1:] = classes[1:] != classes[:-1]
        new[starts] = True
        firsts, before = np.flatnonzero(new), np.concatenate([[0], np.cumsum(new)])
        up, down = powers(0x2545F4914F6CDD1D, len(firsts) + 1)
        total = np.zeros(len(firsts) + 1, np.uint64)
        np.cumsum((classes[firsts].astype(np.uint64) + np.uint64(1)) * up[: len(firsts)], out=total[1:])
        low, high = before[starts], before[ends]  # runs that begin before the word, and before its end
        shape = mix((total[high] - total[low]) * down[low]) + self.same.astype(np.uint64)
        return (mix(shape) % np.uint64(FEATURES)).astype(np.int64)

    def of(self, which: np.ndarray) -> Measures:
        """The same of some of the texts alone."""
        spans = [self.words.flat[self.at[d] : self.at[d + 1]] for d in which.tolist()]
        return Measures(np.concatenate(spans), np.concatenate([[0], np.cumsum([len(x) for x in spans])]))

    def pattern(self) -> np.ndarray:
        """A bit per labeller: does it vote?"""
        out = np.zeros(len(self.n), np.int64)
        for k, (_, needs) in enumerate(LABELLERS.values()):
            votes = self.n >= FEW
            for name, (low, high) in needs.items():
                votes = votes & (self.values[name] >= low) & (self.values[name] < high)
            out += votes << k
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, share of the document's words), sorted."""
        pairs, counts = np.unique(self.doc * FEATURES + self.feature, return_counts=True)
        doc = pairs // FEATURES
        return doc, pairs % FEATURES, counts / self.n[doc]


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of junk for each pattern, each labeller's accuracy (how often its vote is right), the share of junk.

    Each labeller votes at a rate of its own in either class, so that its silence counts too. EM starts from majority
    votes. Documents on which all are silent (the short ones) say nothing: they get the share of junk itself.
    """
    patterns = np.array([p for p in sorted(counts) if p] or [0])
    weight = np.array([counts.get(p, 0) for p in patterns], float)
    says = np.array([vote for vote, _ in LABELLERS.values()])
    votes = patterns[:, None] >> np.arange(len(says)) & 1
    junk = np.where(votes @ says > votes @ (1 - says), 0.9, 0.1)
    for _ in range(rounds):
        both = np.stack([1 - junk, junk]) * weight
        share = (both[1].sum() + 0.1) / (weight.sum() + 1)
        rate = (both @ votes + 0.1) / (both.sum(1, keepdims=True) + 1)
        logs = np.log(rate) @ votes.T + np.log(1 - rate) @ (1 - votes.T) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        done, junk = np.abs(new - junk).max() < 1e-9, new
        if done:
            break
    right = np.where(says, rate[1] * share, rate[0] * (1 - share)) / (rate[1] * share + rate[0] * (1 - share))
    return {0: float(share)} | dict(zip(patterns.tolist(), junk.tolist())), right, float(share)


def fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, junk: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model of junk, by full-batch Adam."""
    w = np.zeros(FEATURES + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, value * w[feature], len(junk)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - junk) / max(1, len(junk))
        g = np.append(np.bincount(feature, value * miss[doc], FEATURES), miss.sum()) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights; None for an empty table."""
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    least = texts.groupBy(F.pmod("key", F.lit(sample)).alias("part")).agg(F.min("key").alias("key"))
    keys = np.sort(np.array([r["key"] for r in least.collect()], np.int64))  # at most `sample`
    if not len(keys):
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # of the sample
        for batch in batches:
            key = batch.column(1).to_numpy()
            wanted = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            for first, flat, at in runs(batch.column(0)):
                seen = Measures(flat, at)
                features: list = [None] * len(seen.n)
                shares: list = [None] * len(seen.n)
                take = np.flatnonzero(wanted[first : first + len(seen.n)] & (seen.n > 0))
                take = np.array([d for d, k in zip(take.tolist(), key[first + take].tolist()) if k not in told and not told.add(k)], np.int64)
                if len(take):
                    doc, feature, value = seen.of(take).features()
                    edges = np.searchsorted(doc, np.arange(len(take) + 1))
                    for k, d in enumerate(take):
                        features[d], shares[d] = feature[edges[k] : edges[k + 1]], value[edges[k] : edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(key[first : first + len(seen.n)]), pa.array(seen.pattern()), pa.array(features, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))], names=["key", "pattern", "features", "shares"])

    seen = materialize(texts.mapInArrow(measure, "key long, pattern long, features array<long>, shares array<double>"))
    different = seen.select("pattern", "key").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["pattern"]: r["n"] for r in different.collect()}  # at most 2**8 rows
    junk, _, _ = estimate(counts)
    rows = seen.where("features IS NOT NULL").dropDuplicates(["key"]).orderBy("key").collect()  # at most `sample`
    if not rows:
        return np.zeros(FEATURES + 1)
    sizes = [len(r["features"]) for r in rows]
    return fit(np.repeat(np.arange(len(rows)), sizes), np.concatenate([r["features"] for r in rows]), np.concatenate([r["shares"] for r in rows]), np.array([junk[r["pattern"]] for r in rows]))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a further column: the probability (from 0 to 1) that a document is clean; null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in (part for whole in batches for part in slices(whole, at_text)):
            found = []
            for _, flat, at in runs(batch.column(at_text)):
                seen = Measures(flat, at)
                z = np.bincount(seen.doc, w[seen.feature], len(seen.n)) / np.maximum(seen.n, 1) + w[-1]
                found.append(np.where(seen.n > 0, 1 / (1 + np.exp(np.clip(z, -60, 60))), np.nan))
            value = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=np.isnan(value))], names=[*batch.schema.names, out])

    kept = aside(docs, out)
    at_text = kept.columns.index(text)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return kept.mapInArrow(over, f"{schema}`{out}` double")


def keep_clean(docs: DataFrame, text: str = "text", columns: tuple[str, ...] | None = None, out: str | None = "quality") -> DataFrame:
    """The documents that the classifier keeps: all columns, or those named (text is read anyway), and their score as
    `out`, if that is not None."""
    wanted = list(columns or docs.columns)
    slim = docs.select(*dict.fromkeys((*wanted, text)))
    slim, named = (slim, fresh(slim, "score")[0]) if out is None else (aside(slim, out), out)
    wanted = slim.columns[: len(wanted)]
    weights = train(docs, text)
    scored = slim.withColumn(named, F.lit(None).cast("double")) if weights is None else score(slim, weights, text, named).where(f"`{named}` IS NULL OR `{named}` >= 0.5")
    return scored.select(*wanted, *([named] if out else []))
