"""The conversation trie, the toxicity field and the Merkle manifest against plain Python, over odd rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldrec.llm import merkle, queries, toxicity, trie
from goldrec.llm.common import materialize, number_in_order

SF = "/root/testdata/sf0.01"
sha = lambda *texts: hashlib.sha256("".join(texts).encode()).hexdigest()


def run(spark, where, name, columns):
    out = queries.QUERIES[name](spark, where)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns, kinds
    return out.collect()


# Places in hot groups


def test_number_in_order(spark):
    data = [(g, v) for g, n in (("a", 300), ("b", 7), ("", 1)) for v in [None, None, *(i // 3 for i in range(n))]]
    rows = materialize(spark.createDataFrame(data, "g string, v long").repartition(5))
    got = number_in_order(rows, ["g"], ["v"]).collect()
    for g in ("a", "b", ""):
        mine = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        want = sorted((v for k, v in data if k == g), key=lambda v: (v is not None, v))
        assert [v for _, v in mine] == want and [p for p, _ in mine] == list(range(len(want))) and {r["n"] for r in got if r["g"] == g} == {len(want)}


# Conversations


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], sha(ends)))
    return collections.Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    """Copies, long shared beginnings, nulls, repeated and unnumbered turns, turnless rebuilt conversations."""
    data = [(7, None, None, None), (7, 0, "user", "☃𝄞"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 1, "user", "lost"), (201, 0, "user", "alone"), (203, 0, "", ""), (99_999, 3, "user", "x" * 50_000)]
    for c in (0, 1, 2, 3, 5, 100, 101, 117, 150):
        data += [(c, t, ("system", "user", "assistant")[t % 3], f"turn {t if c % 2 else min(t, 4)}") for t in range(c % 9 + 1)]
    for c in range(400, 460):  # copies of one
        data += [(c, t, "user", f"copy {t}") for t in range(7)]
    for c in (500, 501, 502):  # alike for 40 turns
        data += [(c, t, "user", f"long {t}" if t < 40 or c == 500 else f"long {t} of {c}") for t in range(45 + c % 3)]
    return data


def test_op11(spark, talks, tmp_path):
    spark.createDataFrame(talks, TURNS).withColumn("key", F.lit("own")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = run(spark, str(tmp_path), "op11_trie", {c: "string" if c == "ends_sha256" else "bigint" for c in trie.NODE})
    assert collections.Counter(map(tuple, rows)) == brute_trie(talks)


@pytest.mark.parametrize("kind", ["empty", "one", "turnless"])
def test_trie_of_little(spark, kind):
    data = {"empty": [], "one": [(42, 0, "user", "a"), (42, 1, "user", "b")], "turnless": [(c, 0, "user", "a") for c in range(1, 40)]}[kind]
    got = trie.conversation_trie(spark.createDataFrame(data, TURNS))
    assert collections.Counter(map(tuple, got.collect())) == brute_trie(data)


def test_rounds_do_not_matter(spark, talks):
    turns, convs = trie.rebuild(spark.createDataFrame(talks, TURNS))
    one, other = (trie.refine(turns, convs, *w) for w in ((1, 1), (2, 512)))
    for a, b in zip(one, other):
        assert collections.Counter(map(tuple, a.collect())) == collections.Counter(map(tuple, b.collect()))


def test_trie_with_texts(spark, talks):
    got = trie.conversation_trie(spark.createDataFrame(talks, TURNS), texts=True).collect()
    assert len(got) == sum(brute_trie(talks).values())
    assert {(r["role"], r["text"]) for r in got if r["conv_id"] == 400 and r["depth"]} == {("user", f"copy {t}") for t in range(7)}
    assert [r["text"] for r in got if r["depth"] == 0] == [None]


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = materialize(spark.createDataFrame([(k, 1, v) for k in (1, 2) for v in range(0, 3000, k)], "node long, depth long, conv long").repartition(4))
    got = trie.joined_sha256(rows, ["node", "depth"], "conv").collect()
    assert {r["node"]: r["sha256"] for r in got} == {k: sha(",".join(map(str, range(0, 3000, k)))) for k in (1, 2)}


# Toxicity


def brute_marginals(odds, after):
    """By all labelings."""
    first, up, down, stay = np.exp(after)
    follow = {(0, 0): 1.0, (0, 1): up, (1, 0): down, (1, 1): stay}
    total, each = 0.0, np.zeros(len(odds))
    for y in itertools.product((0, 1), repeat=len(odds)):
        w = first if y[0] else 1.0
        for t, v in enumerate(y):
            w *= (odds[t] if v else 1.0) * (follow[y[t - 1], v] if t else 1.0)
        total += w
        each += w * np.array(y)
    return each / total


def test_marginals():
    rng = np.random.default_rng(1)
    sizes, after = [1, 3, 10, 2, 7, 1], np.array([-0.5, 0.7, -1.0, 2.0])
    odds = np.exp(rng.normal(0, 3, sum(sizes)))
    new = np.zeros(len(odds), bool)
    new[np.cumsum([0, *sizes[:-1]])] = True
    want = np.concatenate([brute_marginals(part, after) for part in np.split(odds, np.cumsum(sizes)[:-1])])
    assert np.allclose(toxicity.marginals(odds, new, after), want)
    long = np.exp(rng.normal(0, 2, 1000))  # one text over many rows of the scan
    start = np.arange(1000) == 0
    got = toxicity.marginals(long, start, after)
    first, up, down, stay = np.exp(after)
    a, b = np.zeros((1000, 2)), np.ones((1000, 2))
    step = np.array([[1, up], [down, stay]])
    for t in range(1000):
        a[t] = (np.array([1, first]) if t == 0 else a[t - 1] @ step) * [1, long[t]]
        a[t] /= a[t].sum()
    for t in range(998, -1, -1):
        b[t] = step @ (b[t + 1] * [1, long[t + 1]])
        b[t] /= b[t].sum()
    assert np.allclose(got, (a * b)[:, 1] / (a * b).sum(1))


def test_words_and_features():
    texts = ["Éa b. Cd 12x", "", "éa"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    words = toxicity.Tokens(np.frombuffer(b"".join(raw), np.uint8), at)
    flat = b"".join(raw)
    assert [flat[a:b].decode() for a, b in zip(words.starts, words.ends)] == ["Éa", "b", "Cd", "x", "éa"]
    assert words.shape.tolist() == [1 + 2, 0 + 4, 1 + 2, 0, 1]
    features = words.features()
    assert features[0, 0] == features[4, 0] and len(set(features[:4, 0].tolist())) == 4


LABELLED = "doc_id long, text string, toxic int"


def planted(n=400):
    """Invented prose; every fifth text has some words that begin with one of two stems."""
    rng = np.random.default_rng(5)
    syllables = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(5, 120))]
        if i % 5 == 0:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words)), ("zorq", "vixxu")[i // 5 % 2] + word())
        out.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    copied = " ".join(word() for _ in range(60))
    return out + [(n + i, copied + f" {i}", 1) for i in range(30)]  # toxic by label alone, all alike


def test_toxic_words_are_found(spark):
    data = planted()
    table = spark.createDataFrame(data, LABELLED)
    scorer = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), "doc_id % 3 <> 0")
    out = {r["doc_id"]: r for r in toxicity.score(table.select("doc_id", "text", F.lit("own").alias("score")), scorer).collect()}
    held = [(out[i]["score"] >= toxicity.TOXIC, toxic) for i, _, toxic in data if i % 3 == 0 and i < 400]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r["kept_score"] == "own" for r in out.values())
    marked = [(out[i]["spans"], text) for i, text, toxic in data if toxic and i < 400]
    found = [text[int(a) : int(b)] for spans, text in marked for a, b in (s.split(":") for s in spans.split(",") if s)]
    assert len(found) >= len(marked) and all(w.startswith(("zorq", "vixxu")) for w in found)


@pytest.mark.parametrize("kind", ["no labels", "one class", "nothing"])
def test_without_labels(spark, odd, nothing, kind):
    docs = nothing if kind == "nothing" else odd
    labels = docs.select("doc_id", F.lit(1 if kind == "one class" else None).cast("int").alias("toxic"))
    scores = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scores) == (kind != "nothing") and all((s > 0.5) == (kind == "one class") for s in scores)


def test_op12(spark, odd, tmp_path):
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    corpus.select("doc_id", "text", "lang", "source", "n_chars").union(odd.drop("size").withColumn("doc_id", F.col("doc_id") + 5_000_000)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.union(spark.createDataFrame([(5_000_003, None, None), (None, 0, 1), (5_000_103, 1, 0), (5_000_103, 1, 0)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    rows = run(spark, str(tmp_path), "op12_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert len(rows) == corpus.count() + odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert sum(b > g for b in bad for g in good) >= 0.95 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in bad) >= 0.9 * len(bad) and sum(s >= 0.3 for s in good) <= 0.05 * len(good)
    texts = collections.defaultdict(set)
    for d, r in zip(sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), key=str), sorted(rows, key=str)):
        texts[d["doc_id"]].add(r["score"])
    same = {r["score"] for r in rows if r["doc_id"] is not None and 5_000_100 <= r["doc_id"] < 5_000_140}
    assert len(same) == 1


# Merkle


def brute_merkle(rows, changed, fanout=8):
    """doc_id, leaf, subroot, root, proof and its digest, folded root, verified."""

    def leaf(r):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def proof(nodes, at):
        out = []
        while len(nodes) > 1:
            first = at // fanout * fanout
            out.append((nodes[first:at], nodes[at + 1 : first + fanout]))
            nodes, at = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], at // fanout
        return out, nodes[0]

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    leaves = {g: [leaf(r) for r in ordered[g]] for g in names}
    subroots = [proof(leaves[g], 0)[1] for g in names]
    out = []
    for k, g in enumerate(names):
        upper, root = proof(subroots, k)
        for i, r in enumerate(ordered[g]):
            steps = proof(leaves[g], i)[0] + upper
            now = leaf(changed(r))
            for before, after in steps:
                now = sha(*before, now, *after)
            siblings = [x for step in steps for part in step for x in part]
            out.append((r[0], leaves[g][i], subroots[k], root, sha(*siblings), now, now == root))
    return collections.Counter(out)


def tampered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else r


def test_op13(spark, odd, tmp_path):
    langs = [None, "", "de", "en", "é", "z"]
    data = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()]
    data += [(1000 + i, f"Text Nr. {i} ÄÖ", langs[i % 6], None if i % 7 == 0 else f"s{i % 5}", i) for i in range(700)]
    data += [(2000 + i, "x", f"lang{i:02}", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("own"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    rows = run(spark, str(tmp_path), "op13_merkle", {c: "string" for c in merkle.OUTPUTS if c not in ("proof", "verified")} | {"doc_id": "bigint", "verified": "boolean"})
    want = brute_merkle([(d, s, g, n, t) for d, t, g, s, n in data], tampered)
    assert collections.Counter(map(tuple, rows)) == want and 0 < sum(r["verified"] for r in rows) < len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 30])
def test_proofs_lead_to_the_root(spark, n):
    """Small fanout and superblocks of every height; whole proofs; one group and one group a row; kept columns."""
    docs = spark.createDataFrame([(i, f"t{i}", None, f"g{i}", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit("own"))
    for group in ("lang", "source"):
        for levels in (1, 2):
            out = merkle.manifest(docs, group=group, fanout=2, levels=levels, keep=("doc_id", "root")).collect()
            assert len(out) == n and len({r["root"] for r in out}) == (n > 0)
            want = {w[0]: w for w in brute_merkle([(i, f"g{i}", None if group == "lang" else f"g{i}", i, f"t{i}") for i in range(n)], lambda r: r, 2)} if group == "lang" else {}
            for r in out:
                assert r["kept_root"] == "own" and r["verified"]
                steps = [(s["place"], "".join(s["siblings"])) for s in r["proof"]]
                assert merkle.fold(r["leaf"], steps) == r["root"] and (r["leaf"] == r["root"] or merkle.fold(sha("other"), steps) != r["root"])
                if want:
                    assert (r["subroot"], r["root"], r["proof_sha256"]) == want[r["doc_id"]][2:5]


def test_topk_sql_on_repeated_ids(spark, tmp_path):
    """The query's SQL leaves out the query's own row only, as the operator does."""
    import duckdb

    rng = np.random.default_rng(8)
    data = [(i // 3 * 50, [float(x) for x in rng.normal(size=8).astype("float32")]) for i in range(90)] + [(100, None), (None, [1.0] * 8)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.QUERIES["op9_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(db.execute(queries.ORACLE_SQL["op9_topk"]).fetchall())


@pytest.mark.parametrize("name", ["op11_trie", "op13_merkle"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(want.fetchall())
