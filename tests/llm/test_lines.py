import collections
import re

import pytest
from pyspark.sql import functions as F

from goldrec.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """text -> its group of near copies among the texts."""
    texts = sorted(texts)
    sets, up, by_shingle = [shingles(t) for t in texts], list(range(len(texts))), collections.defaultdict(list)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for j, s in enumerate(sets):
        for i, both in collections.Counter(i for x in s for i in by_shingle[x]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(s) - both):
                up[top(j)] = top(i)
        for x in s:
            by_shingle[x].append(j)
    return {t: top(i) for i, t in enumerate(texts)}


def brute(rows, min_docs, depth=3, half=0.5):
    texts, kinds = {t for _, t in rows if t is not None}, collections.defaultdict(set)
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    for t in texts:
        for line in t.split("\n"):
            if mask(line):
                kinds[mask(line)].add(t)
    leaf = lambda k: (len(k), k[:depth])
    leaves = collections.defaultdict(list)
    for k in kinds:
        leaves[leaf(k)].append(k)
    template = {}
    for group in leaves.values():
        total = sum(len(kinds[k]) for k in group)
        free = set()
        if len(group) > 1 and total >= min_docs:
            for i in range(len(group[0])):
                count = collections.Counter()
                for k in group:
                    count[k[i]] += len(kinds[k])
                if max(count.values()) < half * total:
                    free.add(i)
        for k in group:
            g = tuple("<*>" if i in free else w for i, w in enumerate(k))
            template[k] = (leaf(k), g if sum(len(re.findall(r"<\*>", w)) for w in g) <= len(k) - half * len(k) else k)
    held = collections.defaultdict(set)
    for k, where in kinds.items():
        held[template[k]] |= where
    held = {g: where for g, where in held.items() if len(where) >= min_docs}
    group = groups(set().union(*held.values()))
    recurring = {g for g, where in held.items() if len({group[t] for t in where}) >= min_docs}
    out = collections.Counter()
    for doc, t in rows:
        parts = t.split("\n") if t is not None else []
        drop = [bool(mask(x)) and template[mask(x)] in recurring for x in parts]
        out[doc, "\n".join(x for x, d in zip(parts, drop) if not d) if any(drop) else t, len(parts), sum(drop)] += 1
    return out


def check(frame, min_docs):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    got = lines.drop_recurring(frame, min_docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    want = brute(rows, min_docs)
    assert collections.Counter(map(tuple, got)) == want
    return want


def test_variable_fields(spark):
    names = ["Ann", "Bob", "Cyd", "Dan", "Eve", "Fay"]
    body = lambda n: " ".join(n.lower() + "abcdefghijklmnop"[i:] for i in range(16))
    texts = [f"{body(n)}\nPosted on Monday by {n} at noon today\nPage 7{i} of 9" for i, n in enumerate(names)]
    want = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
    assert all(n == 2 for _, _, _, n in want), want


@pytest.mark.parametrize("min_docs", [2, 10])
def test_corpus(spark, min_docs):
    assert sum(n for _, _, _, n in check(spark.read.parquet(f"{SF}/documents.parquet"), min_docs))


def test_odd_rows(spark, odd, nothing):
    check(odd, 2)
    own = {c: F.lit(f"own {c}") for c in ("n_lines", "row_key", "gone", "_row_key", "_gone")}
    clash = odd.withColumns(own)
    out = lines.drop_recurring(clash, 2, length="n_chars")
    assert out.count() == odd.count() and set(out.columns) == {*odd.columns, *own, "kept_n_lines", "n_dropped"}
    assert all(r["kept_n_lines"] == "own n_lines" and r["row_key"] == "own row_key" and r["_gone"] == "own _gone" for r in out.collect())
    bare = lines.drop_recurring(clash, 2, length="n_chars", counts=False)
    assert bare.columns == clash.columns and all(r["n_lines"] == "own n_lines" and r["n_chars"] == len(r["text"] or "") or r["n_chars"] in (1, None) for r in bare.collect())
    assert lines.drop_recurring(nothing).collect() == []


def test_short_carriers_lose_lines_and_near_copies_count_once(spark):
    notice = "This work is free to use for all who ask"
    word = lambda k, i: f"{'abcdefghij'[k]}{'klmnopqrst'[i % 10]}{'uvwxyz'[i // 10 % 6]}"
    carriers = [f"{' '.join(word(k, i) for i in range(5))}\n{notice}" for k in range(4)]
    body = [" ".join(f"{w}{'abcdefghijkl'[i]}" for w in ("lorem", "ipsum", "dolor", "sit", "amet", "quid", "nunc", "erat")) for i in range(12)]
    copies = ["\n".join([*body, f"end {word(k, 7)}"]) for k in range(5)]
    assert all(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for a in copies for b in copies)
    texts = [*carriers, *copies, notice]
    got = {r["doc_id"]: r for r in lines.drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    for i, t in enumerate(carriers):  # ten of fifteen words recur
        assert (got[i]["text"], got[i]["n_dropped"]) == (t.split("\n")[0], 1)
    for i, t in enumerate(copies, len(carriers)):
        assert (got[i]["text"], got[i]["n_dropped"]) == (t, 0)
    assert (got[9]["text"], got[9]["n_dropped"], got[9]["n_lines"]) == ("", 1, 1)


def test_query_spares_no_document(spark):
    from goldrec.llm.queries import op7_lines

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {doc: (n, dropped) for doc, _, n, dropped in brute(rows, 10)}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in op7_lines(spark, SF).collect()} == want
    assert sum(n for _, n in want.values())
