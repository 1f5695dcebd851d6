"""Line deduplication with a log-template tree of fixed depth: lines whose template recurs across documents go.

Level 1 of the tree is a line's token count, the next levels are its leading tokens; tokens with a digit are variable
from the start. In a leaf, a place where no token holds at least half of the lines is a variable field too. A line's
template is its tokens with all variable fields masked, provided that at least half of them stay; else its tokens with
only those with digits masked. Every rule is counted over all documents.

A template recurs if at least `min_docs` groups of near copies hold it: holders are counted by the components of the
n-gram join over all texts that hold a template of `min_docs` different texts. Recurring lines go in every document,
however many of its words they make up. What stays of a text is its other lines, as they were.

Lines travel as 64-bit hashes of their tokens, leaves and masked forms. A leaf can have variable fields only if it holds
several kinds of lines and enough documents; of those leaves, one line of each kind is read again for its tokens.

A null text stays null; blank lines stay; repeated rows are treated alike. Columns named like the counts that are added
come out as kept_ and their name. A text and the arrays over it must fit a task. Leaves are only counted and joined, so no
task holds a leaf, however many lines it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from goldrec.llm.common import aside, broadcast_if_small, fresh, key_of, materialize
from goldrec.llm.ngram_join import near_components
from goldrec.llm.words import Sequences, Words, mix, runs, signed

MIN_DOCS, DEPTH, HALF = 10, 3, 0.5
#: The hash of a masked token.
MASK = Words(np.frombuffer(b"<*>", np.uint8), np.array([0, 3])).hashes()[0]


class Lines:
    """The lines of some texts that have tokens, and the hashes of their tokens, those with a digit masked."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, depth: int):
        words = Words(flat, at)
        self.counts = words.counts
        digits = np.concatenate([[0], np.cumsum((flat >= 48) & (flat <= 57))])
        self.tokens = np.where(digits[words.ends] > digits[words.starts], MASK, words.hashes())
        breaks = np.flatnonzero(flat == 10)
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        line = np.searchsorted(breaks, words.starts)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        self.heads = np.flatnonzero(new)
        self.tails = np.append(self.heads[1:], len(doc)).astype(np.int64)[: len(self.heads)]
        self.doc = doc[self.heads]
        self.line_no = line[self.heads] - np.searchsorted(breaks, at[:-1])[self.doc]
        sequences = Sequences(self.tokens)
        self.n_tokens = self.tails - self.heads
        self.masked = sequences.of(self.heads, self.tails)
        self.leaf = mix(sequences.of(self.heads, np.minimum(self.heads + depth, self.tails)) + self.n_tokens.astype(np.uint64))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """row_key, text_key, words (of the text), line_no, n_tokens, leaf and masked of every line that has tokens."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_key, text_key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, flat, at in runs(batch.column(2)):
                seen = Lines(flat, at, depth)
                row = first + seen.doc
                cols = [row_key[row], text_key[row], seen.counts[seen.doc].astype(np.int64), seen.line_no.astype(np.int32), seen.n_tokens.astype(np.int32), signed(seen.leaf), signed(seen.masked)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["row_key", "text_key", "words", "line_no", "n_tokens", "leaf", "masked"])

    return docs.select("row_key", "text_key", "text").mapInArrow(over, "row_key long, text_key long, words long, line_no int, n_tokens int, leaf long, masked long")


def _read_again(docs: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """leaf, masked, line and tokens (hashes) of single lines; wanted has row_key and line_no."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [set(x) for x in batch.column(1).to_pylist()]
            for first, flat, at in runs(batch.column(0)):
                seen = Lines(flat, at, depth)
                take = [k for k, (d, no) in enumerate(zip(seen.doc.tolist(), seen.line_no.tolist())) if no in numbers[first + d]]
                if not take:
                    continue
                texts: dict[int, list[str]] = {}
                for d in set(seen.doc[take].tolist()):
                    texts[d] = flat[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace").split("\n")
                tokens = signed(seen.tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(seen.leaf[take])), pa.array(signed(seen.masked[take])),
                        pa.array([texts[int(seen.doc[k])][int(seen.line_no[k])] for k in take]),
                        pa.array([tokens[seen.heads[k] : seen.tails[k]] for k in take], pa.list_(pa.int64())),
                    ],
                    names=["leaf", "masked", "line", "tokens"],
                )

    grouped = wanted.groupBy("row_key").agg(F.collect_set("line_no").alias("_numbers"))  # of one text each
    asked = docs.join(broadcast_if_small(materialize(grouped), items="_numbers"), "row_key").dropDuplicates(["row_key"]).select("text", "_numbers")
    return asked.mapInArrow(over, "leaf long, masked long, line string, tokens array<long>").dropDuplicates(["leaf", "masked"])


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, half: float = HALF) -> tuple[DataFrame, DataFrame]:
    """(kinds of lines with a recurring template, all lines); docs has row_key, text_key and text.

    A kind is (leaf, masked); it comes with its template_key and the number of different texts that hold the template.
    """
    lines = materialize(_lines(docs, depth))
    # Kinds of lines with the number of different texts that hold them, and a place of one; the tree is grown from these.
    per_text = lines.groupBy("leaf", "masked", "text_key").agg(F.min("row_key").alias("row_key"), F.min_by("line_no", "row_key").alias("line_no"))
    kinds = materialize(per_text.groupBy("leaf", "masked").agg(F.count(F.lit(1)).alias("docs"), F.min("row_key").alias("row_key"), F.min_by("line_no", "row_key").alias("line_no")))
    grown = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("docs").alias("_docs")).where(f"_kinds > 1 AND _docs >= {min_docs}").select("leaf", "_docs")
    inner = materialize(kinds.join(grown, "leaf"))
    read = materialize(inner.select("leaf", "masked", "docs", "_docs").join(_read_again(docs, inner.select("row_key", "line_no"), depth), ["leaf", "masked"]))
    shares = read.select("leaf", "_docs", "docs", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "_docs", "place", "token").agg(F.sum("docs").alias("_n")).groupBy("leaf", "_docs", "place").agg(F.max("_n").alias("_n"))
    fields = shares.where(F.col("_n") < half * F.col("_docs")).groupBy("leaf").agg(F.collect_set("place").alias("_open"))
    mask = F.lit(int(signed(np.array([MASK]))[0]))
    general = F.transform("tokens", lambda x, i: F.when(F.array_contains("_open", i), mask).otherwise(x))
    stay = F.size(F.filter("_general", lambda x: x != mask)) >= half * F.size("tokens")
    named = read.join(fields, "leaf").withColumn("_general", general).select("leaf", "masked", F.xxhash64("leaf", F.when(stay, F.col("_general")).otherwise(F.col("tokens"))).alias("template_key"))
    named = materialize(named)
    # Templates of several kinds are counted by text; a kind that is its own template has its count already.
    held = lines.join(broadcast_if_small(named), ["leaf", "masked"]).select("template_key", "text_key").distinct().groupBy("template_key").agg(F.count(F.lit(1)).alias("docs"))
    merged = named.join(held.where(F.col("docs") >= min_docs), "template_key").select("leaf", "masked", "template_key", "docs")
    single = kinds.where(F.col("docs") >= min_docs).join(named, ["leaf", "masked"], "left_anti").select("leaf", "masked", F.xxhash64("leaf", "masked").alias("template_key"), "docs")
    return materialize(merged.union(single)), lines


def _of_groups(docs: DataFrame, recurring: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """The recurring kinds whose template at least min_docs groups of near copies hold."""
    held = materialize(lines.join(broadcast_if_small(recurring.select("leaf", "masked", "template_key")), ["leaf", "masked"]).select("template_key", "text_key").distinct())
    holders = materialize(docs.select("text_key", "text").join(held.select("text_key").distinct().hint("merge"), "text_key").dropDuplicates(["text_key"]))
    groups = near_components(holders, id_col="text_key").select("text_key", "component_id")
    counted = held.join(groups.hint("merge"), "text_key").select("template_key", "component_id").distinct().groupBy("template_key").agg(F.count(F.lit(1)).alias("_groups"))
    return materialize(recurring.join(counted.where(F.col("_groups") >= min_docs), "template_key", "left_semi"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, half: float = HALF, text: str = "text", id_col: str = "doc_id", length: str | None = None, counts: bool = True) -> DataFrame:
    """docs with recurring lines taken out of the text; counts: n_lines and n_dropped are added.

    length: a column of docs that holds the text's number of characters, to be kept up to date.
    """
    row_key, text_key = key_of(id_col, text), F.xxhash64(text)
    slim = docs.select(row_key.alias("row_key"), text_key.alias("text_key"), F.col(text).alias("text"))
    recurring, lines = templates(slim, min_docs, depth, half)
    recurring = _of_groups(slim, recurring, lines, min_docs)
    gone = lines.join(broadcast_if_small(recurring.select("leaf", "masked")), ["leaf", "masked"])

    kept = aside(docs, "n_lines", "n_dropped") if counts else docs
    columns = kept.columns
    of_row, dropped = fresh(kept, "row_key", "gone")
    # Repeated rows have equal lines: they are one here.
    per_row = materialize(gone.groupBy(F.col("row_key").alias(of_row)).agg(F.collect_set("line_no").alias(dropped)))
    at, size_at = columns.index(text), columns.index(length) if length else -1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths, n_lines, n_dropped = [], [], [], []
            for value, numbers in zip(batch.column(at), batch.column(len(columns))):
                value, numbers = value.as_py(), numbers.as_py()
                parts = value.split("\n") if value is not None else []
                if numbers:
                    drop = set(numbers)
                    value = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                texts.append(value)
                lengths.append(len(value) if numbers else None)
                n_lines.append(len(parts))
                n_dropped.append(len(numbers or ()))
            cols = list(batch.columns[: len(columns)])
            cols[at] = pa.array(texts, cols[at].type)
            if length:
                old = cols[size_at]
                cols[size_at] = pa.array([x if x is not None else y.as_py() for x, y in zip(lengths, old)], old.type)
            more = [pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())] if counts else []
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*columns, "n_lines", "n_dropped"][: len(cols) + len(more)])

    out = kept.withColumn(of_row, row_key).join(per_row.hint("merge"), of_row, "left").select(*columns, dropped)
    more = [StructField("n_lines", IntegerType()), StructField("n_dropped", IntegerType())] if counts else []
    return out.mapInArrow(over, StructType([*kept.schema.fields, *more]))
