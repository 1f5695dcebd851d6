"""One query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.llm import lines, media, merkle, mixing, ngram_join, packing, quality, secrets, sharding, substrings, topk, toxicity, trie

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), vocabulary()))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shard(rows, SHARDS, tie=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_clean(_table(spark, sf_dir, "documents"), columns=("doc_id",))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents"), with_tile=False)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_table(spark, sf_dir, "documents")).drop("text_hash")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, false)"
    scorer = toxicity.train(docs, _table(spark, sf_dir, "labels"), f"NOT {held_out}")
    scored = toxicity.score(docs, scorer, spans=False)
    return scored.select("doc_id", F.expr(held_out).alias("held_out"), "score", F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), changed={"text": tampered}, proofs=False)


QUERIES = {q.__name__: q for q in (op1_mixing, op2_packing, op3_sharding, op4_quality, op5_media, op6_substrings, op7_lines, op8_ngram_join, op9_topk, op10_secrets, op11_trie, op12_toxicity, op13_merkle)}

#: Unsigned CRC-32 of a decimal number: each digit's code, then eight times -1 for a shift.
_CRC32 = """
  xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda d: list_concat([CAST(ord(d) AS BIGINT)], [-1 for _ in range(8)])))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END))"""

ORACLE_SQL: dict[str, str] = {
    "op9_topk": """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_trie": f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h FROM own WHERE k = 1
), turns AS (
  SELECT c.conv_id, 0 AS part, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h
), rebuilt AS (
  SELECT conv_id, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS len, row_number() OVER w AS depth,
         string_agg(sha256(strlen(role) || ':' || role || text), '' ) OVER w AS path
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
), places AS (
  SELECT conv_id, depth, path, chars, len FROM rebuilt
  UNION ALL
  SELECT c.conv_id, 0, '', 0, coalesce(l.len, 0) FROM convs c LEFT JOIN (SELECT DISTINCT conv_id, len FROM rebuilt) l ON c.conv_id = l.conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM places GROUP BY path, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS up, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.path, 64 * n.depth) = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
), above AS (
  SELECT path, depth, saved, n_children, unnest(range(0, depth + 1)) AS d FROM linked
), sums AS (
  SELECT d AS depth, left(path, 64 * d) AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY ALL
)
SELECT l.conv_id, l.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN sums s ON l.depth = s.depth AND l.path = s.path""",
    "op13_merkle": f"""
WITH RECURSIVE v AS (
  SELECT doc_id, lang, text, {'||'.join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head,
         CASE WHEN {_CRC32.format("doc_id")} % 3 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END AS found
  FROM documents
), l AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS found FROM v
), p AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM l
), t AS (
  SELECT g, 0 AS lvl, place AS i, leaf AS digest, n FROM p
  UNION ALL
  SELECT g, lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), max((n + 7) // 8) FROM t WHERE n > 1 GROUP BY g, lvl, i // 8
), roots AS (
  SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, place AS i, subroot AS digest, n FROM roots
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), max((n + 7) // 8) FROM u WHERE n > 1 GROUP BY lvl, i // 8
), low AS (
  SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
  FROM t a JOIN t b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.i
), high AS (
  SELECT a.lvl, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
  FROM u a JOIN u b ON a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lvl, a.i
), steps AS (
  SELECT p.id, low.lvl, before, after FROM p JOIN low ON p.g = low.g AND low.i = p.place // CAST(pow(8, low.lvl) AS BIGINT)
  UNION ALL
  SELECT p.id, 100 + high.lvl, before, after FROM p JOIN roots ON p.g = roots.g JOIN high ON high.i = roots.place // CAST(pow(8, high.lvl) AS BIGINT)
), proofs AS (
  SELECT id, string_agg(before || after, '' ORDER BY lvl) AS siblings, list(before || ':' || after ORDER BY lvl) AS path FROM steps GROUP BY id
), folded AS (
  SELECT p.*, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(p.found, coalesce(path, [])), lambda acc, x: sha256(split_part(x, ':', 1) || acc || split_part(x, ':', 2))) AS folded_root
  FROM p LEFT JOIN proofs ON p.id = proofs.id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN roots ON folded.g = roots.g CROSS JOIN (SELECT digest AS root FROM u WHERE n = 1)""",
}
