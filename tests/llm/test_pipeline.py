import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from goldrec.llm import mixing
from goldrec.llm.common import WORD

SF = "/root/testdata/sf0.01"


def test_mixing_to_weights_keeps_whole_documents(spark, odd):
    """Of each document as many copies as it has whole passes, and one more if at least half of the cut one is taken."""
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet").limit(200)):
        others = tuple(c for c in docs.columns if c != "doc_id")
        want = collections.Counter()
        for r in mixing.mix(docs, keep=others, packed=True).collect():
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r["_kept"]["text"] or ""))
            if n:
                want[str((r["doc_id"], *r["_kept"]))] += r["taken"] // n + (2 * (r["taken"] % n) >= n)
        got = corpus_pipeline.mixing_to_weights(spark, docs, SF)
        assert got.columns == ["doc_id", *others]
        assert collections.Counter(str(tuple(r)) for r in got.collect()) == +want


def test_words_are_counted_without_their_pattern(spark, odd):
    """Counts equal those of the pattern, and no stage goes over whole texts with it."""
    counted = odd.select(mixing.n_words(F.col("text")).alias("n"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("want"))
    assert counted.where("n <> want").isEmpty()
    for stage in (corpus_pipeline.mixing_to_weights, corpus_pipeline.ngram_jaccard_join):
        assert "regexp_count" not in stage(spark, odd, SF)._jdf.queryExecution().toString()
