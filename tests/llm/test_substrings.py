import collections
import hashlib
import re

import numpy as np
import pytest

from goldrec.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return out


def check(frame, window=substrings.WINDOW, gram=substrings.GRAM):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    want = collections.Counter(brute(rows, window))
    assert collections.Counter(tuple(r) for r in substrings.remove_repeats(frame, window, gram).collect()) == want
    assert collections.Counter(tuple(r) for r in substrings.remove_repeats(frame, window, gram, digest=True).collect()) == collections.Counter({(d, n, g, hashlib.sha256(k.encode()).hexdigest()): c for (d, n, g, k), c in want.items()})
    return want


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60 if seed else 4)]
    draw = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    passages = [draw(rng.integers(5, 40)) for _ in range(12)]
    texts = []
    for _ in range(120):
        text = []
        for _ in range(rng.integers(1, 6)):
            part = passages[rng.integers(len(passages))] if rng.random() < 0.5 else draw(rng.integers(1, 30))
            low = rng.integers(0, max(1, len(part) // 2))
            text += part[low:]
        texts.append(" ".join(text))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = check(frame, 10, 3)
    assert sum(g for _, _, g, _ in want)


def test_corpus(spark):
    assert sum(g for _, _, g, _ in check(spark.read.parquet(f"{SF}/documents.parquet")))


def test_odd_rows(spark, odd, nothing):
    long = " ".join(f"a{i}" for i in range(50))
    more = spark.createDataFrame([(900, long), (900, long), (901, "x " + long[3:]), (None, long), (902, "r " * 100)], "doc_id long, text string")
    check(odd.select("doc_id", "text").union(more))
    assert substrings.remove_repeats(nothing).collect() == []
