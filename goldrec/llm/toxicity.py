"""Toxicity by a linear-chain conditional random field over words.

Labels say only that a document is toxic, so words are labelled first: beginnings of words (and whole words) that many
different contexts in toxic documents share and clean ones hardly do are seeds, and a word of a toxic document that has a
seed is a toxic one. Contexts are counted, not documents, so that a passage in many copies counts once. The field is then
trained on labelled words: its features are the word, its first 4, 5, 6 and 8 bytes, and whether a sentence ended before
it, it is a capital one and the next is. Forward-backward marginals of a whole document give the expected number of toxic
words and the surest one, from which a logistic model, fitted to the documents' labels, makes the score; words more
likely toxic than not are reported by offset.

The sample that is fitted to is bounded whatever the corpus: DOCS different labelled texts of either class (the least hash
of each of DOCS parts of the hash range), CHAINS stretches of them of about STRETCH bytes of either class. Everything else
reads all rows: the hashes, the counts that correct the sample for the true share of toxic texts, and the scores.

Scores depend on texts alone: equal texts, equal scores; a text without words (empty, null) has the score of one without
evidence. A document with several labels is toxic if one says so; null labels and rows without a doc_id are not learned
from. Without a toxic and a clean labelled text all scores are the share of toxic ones, 0.5 without any. An empty table
has no rows. A text and the arrays over its words must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import aside, broadcast_if_small, materialize
from goldrec.llm.words import BASES, LOWER, mix, powers, runs, slices

DOCS, CHAINS, STRETCH = 4000, 6000, 800
#: Bytes of the beginnings of a word that are features, besides the whole word.
STARTS = (4, 5, 6, 8)
#: A seed: log-likelihood ratio against chance, and its share of toxic contexts if classes were of one size.
SURE, PURE = 20.0, 0.9
#: A score from which on a document is predicted toxic.
TOXIC = 0.3

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


class Tokens:
    """The words of some texts (runs of letters) with their features."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        inside = np.zeros(len(flat) + 2, bool)
        inside[1:-1] = LETTER[flat]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = at[1:] > at[:-1]
        begins[at[:-1][full]] = inside[1:-1][at[:-1][full]]
        ends[at[1:][full] - 1] = inside[1:-1][at[1:][full] - 1]
        self.starts, self.ends, self.at = np.flatnonzero(begins), np.flatnonzero(ends) + 1, at
        self.first = np.searchsorted(self.starts, at)
        self.low = LOWER[flat]
        wide = (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[:-1] == 0xC3)  # Latin capitals with marks
        self.low[1:][wide] += 0x20
        head = flat[self.starts]
        capital = (head >= 65) & (head <= 90)
        capital |= (head == 0xC3) & np.append(wide, False)[self.starts]
        stops = np.concatenate([[0], np.cumsum(STOP[flat])])
        opens = np.zeros(len(self.starts), bool)
        opens[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
        self.new = np.zeros(len(self.starts), bool)
        self.new[self.first[:-1][np.diff(self.first) > 0]] = True
        after = np.append(capital[1:] & ~self.new[1:], False)
        self.shape = (opens | self.new) + 2 * capital + 4 * after

    def features(self) -> np.ndarray:
        """A row per word: hashes of the whole word and of its beginnings, 0 where it is no longer than that."""
        up, down = powers(BASES[0], len(self.low) + 1)
        sums = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], out=sums[1:])
        size, out = self.ends - self.starts, np.zeros((len(self.starts), 1 + len(STARTS)), np.uint64)
        shift, base = down[self.starts], sums[self.starts]
        out[:, 0] = mix((sums[self.ends] - base) * shift + np.uint64(1))
        for k, n in enumerate(STARTS, 1):
            long = np.flatnonzero(size > n)
            out[long, k] = mix((sums[self.starts[long] + n] - base[long]) * shift[long] + np.uint64(n << 8))
        return out


class Field:
    """Weights of the field: features by hash, shapes (their sum with the bias), and what follows what."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # ascending
        self.weights, self.shapes, self.next = np.zeros(len(keys) + 1), np.full(8, -3.0), np.zeros(4)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def find(self, features: np.ndarray) -> np.ndarray:
        """Places in `weights`; the last (always 0) for a feature that has none."""
        out = np.full(features.shape, len(self.keys), np.int32)
        row, col = np.nonzero(self.maybe[features >> np.uint64(44)])
        value = features[row, col]
        place = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        hit = self.keys[place] == value
        out[row[hit], col[hit]] = place[hit]
        return out

    def odds(self, found: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[found].sum(1) + self.shapes[shape], -30, 30))


def _compose(a, b):
    """Fractional-linear maps (as four arrays) after one another: first a, then b."""
    w, x, y, z = b[0] * a[0] + b[1] * a[2], b[0] * a[1] + b[1] * a[3], b[2] * a[0] + b[3] * a[2], b[2] * a[1] + b[3] * a[3]
    top = np.maximum(np.maximum(w, x), np.maximum(y, z))
    return w / top, x / top, y / top, z / top


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, width: int = 128) -> np.ndarray:
    """x[t] = (a x[t-1] + b) / (c x[t-1] + d) from x = 1, over a long sequence: rows of `width` steps side by side."""
    n = len(a)
    rows = -(-n // width)
    parts = []
    for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        padded = np.full(rows * width, fill)
        padded[:n] = x
        parts.append(np.ascontiguousarray(padded.reshape(rows, width).T))
    whole = tuple(p[0] for p in parts)
    for t in range(1, width):
        whole = _compose(whole, tuple(p[t] for p in parts))
    start, now = np.empty(rows), 1.0
    for r, (w, x, y, z) in enumerate(zip(*(v.tolist() for v in whole))):
        start[r] = now
        now = (w * now + x) / (y * now + z)
    out = np.empty((width, rows))
    for t in range(width):
        start = (parts[0][t] * start + parts[1][t]) / (parts[2][t] * start + parts[3][t])
        out[t] = start
    return out.T.reshape(-1)[:n]


def marginals(odds: np.ndarray, new: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probability that each word is toxic. new: words that begin a text. after: weights of a toxic first word, of toxic
    after clean, clean after toxic and toxic after toxic."""
    if not len(odds):
        return odds
    first, up, down, stay = np.exp(after)
    follows = ~new
    ahead = _scan(odds * stay * follows, odds * np.where(new, first, up), down * follows, np.ones(len(odds)))
    # From the end: what follows a word decides; before a text's first word it says nothing.
    later, open_ = np.append(odds[1:], 1.0)[::-1], np.append(follows[1:], False)[::-1]
    back = _scan(later * stay * open_, np.where(open_, down, 1.0), later * up * open_, np.ones(len(odds)))[::-1]
    both = ahead * back
    return both / (1 + both)


def _train(field: Field, tokens: list[np.ndarray], shapes: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, ridge: float = 0.05) -> None:
    """Fits a field to labelled stretches by full-batch Adam."""
    order = sorted(range(len(tokens)), key=lambda i: -len(tokens[i]))
    length = max(map(len, tokens))
    at = np.full((length, len(order)), -1)
    begin = 0
    for c, i in enumerate(order):
        at[: len(tokens[i]), c] = np.arange(begin, begin + len(tokens[i]))
        begin += len(tokens[i])
    found, shape, y = (np.concatenate([x[i] for i in order]) for x in (tokens, shapes, labels))
    live = [int((at[t] >= 0).sum()) for t in range(length)]
    params = np.concatenate([field.weights[:-1], field.shapes, field.next])
    m, v, n = np.zeros_like(params), np.zeros_like(params), len(field.keys)
    hits = found[found < n]
    hit_token = np.nonzero(found < n)[0]
    given = np.zeros(4)
    for t in range(length):
        now = y[at[t, : live[t]]]
        if t == 0:
            given[0] = now.sum()
        else:
            before = y[at[t - 1, : live[t]]]
            given[1:] += ((1 - before) * now).sum(), (before * (1 - now)).sum(), (before * now).sum()
    for step in range(1, rounds + 1):
        field.weights[:-1], field.shapes, field.next = params[:n], params[n : n + 8], params[n + 8 :]
        odds = field.odds(found, shape)
        first, up, down, stay = np.exp(field.next)
        ahead, back, p = np.zeros(len(odds)), np.ones(len(odds)), np.zeros(len(odds))
        for t in range(length):
            i = at[t, : live[t]]
            if t == 0:
                ahead[i] = odds[i] * first
            else:
                r = ahead[at[t - 1, : live[t]]]
                ahead[i] = odds[i] * (up + stay * r) / (1 + down * r)
        want = np.zeros(4)
        for t in range(length - 1, -1, -1):
            i = at[t, : live[t]]
            if t + 1 < length and live[t + 1]:
                j = at[t + 1, : live[t + 1]]
                q = odds[j] * back[j]
                r = ahead[i[: len(j)]]
                back[i[: len(j)]] = (down + stay * q) / (1 + up * q)
                total = 1 + up * q + down * r + stay * r * q
                want[1:] += (up * q / total).sum(), (down * r / total).sum(), (stay * r * q / total).sum()
            p[i] = ahead[i] * back[i] / (1 + ahead[i] * back[i])
        want[0] = p[at[0, : live[0]]].sum()
        miss = p - y
        g = np.concatenate([np.bincount(hits, miss[hit_token], n)[:n], np.bincount(shape, miss, 8), want - given]) + ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    field.weights[:-1], field.shapes, field.next = params[:n], params[n : n + 8], params[n + 8 :]


def _contexts(value: np.ndarray, context: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different contexts of each value (ascending) among the chosen ones."""
    value, context = value[which], context[which]
    if not len(value):
        return value, np.zeros(0, np.int64)
    order = np.lexsort((context, value))
    value, context = value[order], context[order]
    new = np.append(True, (value[1:] != value[:-1]) | (context[1:] != context[:-1]))
    return np.unique(value[new], return_counts=True)


def fit(texts: list[bytes], toxic: np.ndarray) -> Field | None:
    """A field from stretches of labelled texts; None if nothing tells toxic ones from clean ones."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = Tokens(np.frombuffer(b"".join(texts), np.uint8), at)
    features, n = words.features(), len(words.starts)
    if not n:
        return None
    text = np.searchsorted(words.first, np.arange(n), "right") - 1
    of_toxic, none = toxic[text], np.uint64(0)
    before = np.where(words.new, none, np.append(none, features[:-1, 0]))
    after = np.append(np.where(words.new[1:], none, features[1:, 0]), none)
    total = np.array([(~of_toxic).sum(), of_toxic.sum()], float)  # words, as a measure of either class
    seeds, kept = [], []
    for k in range(features.shape[1]):
        value = features[:, k]
        sides = [_contexts(value, side, of_toxic & (value > 0)) for side in (before, after)]
        names, bad = sides[0][0], np.minimum(sides[0][1], sides[1][1]).astype(float)
        names, bad = names[bad >= 3], bad[bad >= 3]
        clean_names, clean = _contexts(value, before, ~of_toxic & (value > 0))
        good = np.zeros(len(names))
        if len(clean_names) and len(names):
            place = np.minimum(np.searchsorted(clean_names, names), len(clean_names) - 1)
            good = np.where(clean_names[place] == names, clean[place], 0).astype(float)
        share = total / total.sum()
        seen = bad + good
        gain = 2 * (bad * np.log(bad / (seen * share[1])) + good * np.log(np.maximum(good, 1e-9) / (seen * share[0])))
        pure = bad / share[1] / (bad / share[1] + good / share[0])
        seeds.append(names[(gain >= SURE) & (pure >= PURE)])
        kept.append(names[pure >= 0.5])
    seed = np.zeros(n, bool)
    for k, names in enumerate(seeds):
        seed |= np.isin(features[:, k], names)
    if not seed.any():
        return None
    # Features: the likely ones, and all that words with a likely one have besides.
    near = np.zeros(n, bool)
    for k, names in enumerate(kept):
        near |= np.isin(features[:, k], names)
    rest, times = np.unique(features[near], return_counts=True)
    keys = np.union1d(np.concatenate(kept), rest[times >= 3])
    field = Field(keys[keys > 0])
    found = field.find(features)
    label = (seed & of_toxic).astype(float)
    cut = words.first[1:-1]
    stretches = [[part for part in np.split(x, cut)] for x in (found, words.shape, label)]
    full = [i for i, part in enumerate(stretches[2]) if len(part)]
    _train(field, *([part[i] for i in full] for part in stretches))
    return field


def measure(field: Field, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Tokens, np.ndarray]:
    """Of each text: log of the expected number of toxic words, log-odds of the surest; and its words and marginals."""
    words = Tokens(flat, at)
    p = marginals(field.odds(field.find(words.features()), words.shape), words.new, field.next)
    total, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        total[full], most[full] = np.add.reduceat(p, words.first[full]), np.maximum.reduceat(p, words.first[full])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.log(total + 1e-3), np.log(most / (1 - most)), words, p


def stretches(text: bytes, key: int, most: int) -> list[bytes]:
    """A text's stretches of about STRETCH bytes, cut at white space where there is some near; of more than `most`, those
    whose numbers hash least."""
    out, at = [], 0
    while at < len(text):
        to = text.find(b" ", at + STRETCH, at + 2 * STRETCH)
        to = len(text) if at + STRETCH >= len(text) else at + 2 * STRETCH if to < 0 else to
        out.append(text[at:to])
        at = to
    if len(out) <= most:
        return out
    return [out[i] for i in np.argsort(mix(np.arange(len(out), dtype=np.uint64) + np.uint64(key & (1 << 63) - 1)))[:most]]


class Scorer:
    """A field and the logistic model over its measures; without a field, the same score for all."""

    def __init__(self, field: Field | None, model: np.ndarray):
        self.field, self.model = field, model

    def __call__(self, flat: np.ndarray, at: np.ndarray):
        if self.field is None:
            return np.full(len(at) - 1, 1 / (1 + np.exp(-self.model[0]))), None, None
        expected, surest, words, p = measure(self.field, flat, at)
        z = self.model[0] + self.model[1] * expected + self.model[2] * surest
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), words, p


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Bias and slopes (not below 0: more evidence never lowers a score) by Newton steps, over standardized measures."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    use = np.ones(x.shape[1], bool)
    while True:
        a = np.column_stack([np.ones(len(x)), ((x - mean) / spread)[:, use]])
        w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (p - y)) + penalty @ w)
            w = w - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        use[np.flatnonzero(use)[w[1:] < 0]] = False
    slopes = np.zeros(x.shape[1])
    slopes[use] = w[1:] / spread[use]
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def train(docs: DataFrame, labels: DataFrame, learn: str = "true", text: str = "text", docs_most: int = DOCS, chains: int = CHAINS) -> Scorer:
    """A scorer from the documents for which the SQL condition `learn` (over doc_id) holds and that labels.toxic marks."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    slim = docs.where(f"doc_id IS NOT NULL AND ({learn})").select("doc_id", F.xxhash64(text).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    marked = slim.where("size > 0").join(marks, "doc_id").groupBy("key").agg(F.max("toxic").alias("toxic"))
    marked = materialize(marked)
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    clean, bad = counts.get(0, 0), counts.get(1, 0)
    share = Scorer(None, np.array([np.log((bad + 0.5) / (clean + 0.5))]))
    if not clean or not bad:
        return share
    chosen = materialize(marked.groupBy("toxic", F.pmod("key", F.lit(docs_most)).alias("part")).agg(F.min("key").alias("key")).select("key", "toxic"))  # at most 2 * docs_most rows
    found = docs.where(f"doc_id IS NOT NULL AND ({learn})").select(F.col(text).alias("text"), F.xxhash64(text).alias("key")).join(broadcast_if_small(chosen), "key")
    sample = materialize(found.dropDuplicates(["key"]))
    each = {t: max(1, chains // max(1, min(n, docs_most))) for t, n in counts.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, key, k, part) for key, t, value in zip(*(batch.column(i).to_pylist() for i in range(3))) for k, part in enumerate(stretches(value.encode("utf-8", "replace"), key, each[t]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["toxic", "key", "k", "part"])

    parts = sample.select("key", "toxic", "text").mapInArrow(cut, "toxic int, key long, k int, part binary").orderBy("key", "k").toArrow()  # some CHAINS of a few hundred bytes of either class
    field = fit(parts["part"].to_pylist(), parts["toxic"].to_numpy() == 1)
    if field is None:
        return share

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, at in runs(batch.column(1)):
                expected, surest, _, _ = measure(field, flat, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(expected)), pa.array(expected), pa.array(surest)], names=["toxic", "expected", "surest"])

    seen = sample.select("toxic", "text").mapInArrow(measured, "toxic int, expected double, surest double").orderBy("toxic", "expected", "surest").toArrow()  # at most 2 * docs_most rows
    y = seen["toxic"].to_numpy()
    weight = np.where(y == 1, bad / max(1, (y == 1).sum()), clean / max(1, (y == 0).sum()))
    return Scorer(field, _logistic(np.column_stack([seen["expected"].to_numpy(), seen["surest"].to_numpy()]), y, weight / weight.mean()))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with score, and with spans: start:end (code points, end exclusive) of words more likely toxic than not,
    joined by commas. A column that is named like one of these comes out as kept_ and its name."""
    names = ["score", *["spans"] * spans]
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in (part for whole in batches for part in slices(whole, at_text)):
            values, found = [], []
            for _, flat, at in runs(batch.column(at_text)):
                value, words, p = scorer(flat, at)
                values.append(value)
                if spans:
                    found += _spans(flat, at, words, p)
            columns = [pa.array(np.concatenate(values) if values else np.zeros(0)), *([pa.array(found, pa.string())] if spans else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    kept = aside(docs, *names)
    at_text = kept.columns.index(text)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return kept.mapInArrow(over, f"{schema}score double" + ", spans string" * spans)


def _spans(flat: np.ndarray, at: np.ndarray, words: Tokens | None, p: np.ndarray | None) -> list[str]:
    out = [[] for _ in range(len(at) - 1)]
    if p is not None:
        marks = np.flatnonzero(p > 0.5)
        if len(marks):
            points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            doc = np.searchsorted(words.first, marks, "right") - 1
            for d, a, b in zip(doc.tolist(), (points[words.starts[marks]] - points[at[doc]]).tolist(), (points[words.ends[marks]] - points[at[doc]]).tolist()):
                out[d].append(f"{a}:{b}")
    return [",".join(x) for x in out]
