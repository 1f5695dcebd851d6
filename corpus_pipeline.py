"""A corpus pipeline in five stages, each an operator of goldrec.llm with its decisions put into effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldrec.llm import lines, mixing, ngram_join, packing, quality
from goldrec.llm.common import materialize
from goldrec.llm.queries import vocabulary

#: Bytes of an Arrow batch where the session sets none: whole texts pass through the workers of the stages' last steps.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return quality.keep_clean(docs, out=None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    small_batches(spark)
    return lines.drop_recurring(docs, length="n_chars", counts=False)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return ngram_join.keep_first(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents are there as often as its target weight says, shard by shard in random order.

    Documents stay whole: the one copy of a source that the mix would cut is there if at least half of it is taken.
    """
    small_batches(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    taken = mixing.copies(mixing.mix(docs, keep=others, packed=True))
    return mixing.shuffled(taken.where("2 * words >= size")).select("doc_id", "_kept.*").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
