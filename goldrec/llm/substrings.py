"""Substring deduplication by seed and extend: words inside windows whose word sequence also starts elsewhere go.

1. Seeds. Of the k-grams in each window the one with the smallest hash (the leftmost, on a tie) is its anchor; equal
   windows choose equal anchors at the same place in them. Documents meet on anchors that occur twice.
2. Extension. The windows that share one anchor occurrence are consecutive: together they are the stretch to which
   that anchor can extend both ways. Occurrences with equal stretches are repeats at full extent, and all their windows
   go. Where an anchor has different stretches, one of each repeated kind and all the unrepeated ones are compared
   window by window, which finds how far each can be extended.
3. Overlapping windows merge into maximal repeats; their words are removed.

Groups are only counted and joined, so no task or row holds all places of a frequent passage. Windows are told apart
by 128 bits. A null text has no words; texts shorter than a window lose none; repeated rows (whatever their ids) are
repeats of one another. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import key_of, materialize
from goldrec.llm.words import Sequences, Words, runs, signed, slices

WINDOW, GRAM = 35, 8
#: A place: 24 bits of a second text hash, 34 of the first window's first word, 6 of the number of further windows.
SPAN_BITS, WORD_BITS = 6, 34


def _anchors(words: Words, grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor's word, first and last window start) of each anchor occurrence, as places in the run."""
    per_doc = np.maximum(words.counts - window + 1, 0)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + words.first[:-1][doc]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    width = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, width)[: int(start[-1]) + 1].argmin(1)[start] + start
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    return doc[heads], least[heads], start[heads], start[tails]


def seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, stretch, row_key, place) of all anchor occurrences; docs has row_key, second and text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, second = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, flat, at in runs(batch.column(2)):
                words = Words(flat, at)
                if len(words.starts) < window:
                    continue
                sequences = Sequences(words.hashes())
                every = np.arange(len(words.starts) - gram + 1)
                grams = sequences.of(every, every + gram)
                doc, anchor, low, high = _anchors(words, grams, window, gram)
                row = first + doc
                place = (second[row] << (SPAN_BITS + WORD_BITS)) | ((low - words.first[doc]) << SPAN_BITS) | (high - low)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[anchor])), pa.array(signed(sequences.of(low, high + window))), pa.array(keys[row]), pa.array(place)], names=["anchor", "stretch", "row_key", "place"])

    return docs.select("row_key", "second", "text").mapInArrow(over, "anchor long, stretch long, row_key long, place long")


def _removed(n: int, window: int, intervals) -> np.ndarray:
    """Which of n words are inside (first window start, further windows) intervals."""
    edges = np.zeros(n + 1, np.int64)
    for low, more in intervals:
        edges[low] += 1
        edges[min(n, low + more + window)] -= 1
    return np.cumsum(edges[:-1]) > 0


def _unpack(place: int) -> tuple[int, int]:
    return place >> SPAN_BITS & (1 << WORD_BITS) - 1, place & (1 << SPAN_BITS) - 1


def _outcome(raw: bytes, window: int, places, digest: bool) -> tuple[int, int, str]:
    words = raw.split()  # on just the white space that ends words here
    gone = _removed(len(words), window, map(_unpack, places)) if len(places) else ()
    kept = b" ".join(compress(words, ~gone) if len(places) else words)
    return len(words), int(sum(gone)), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, n_words, n_removed and kept (the words left, joined by one space).

    digest: kept is their SHA-256 instead, so that whole texts needn't be written. window - gram must be below 63.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), key_of(id_col, text).alias("row_key"), F.pmod(F.hash(text, F.lit(1)), F.lit(1 << 23)).cast("long").alias("second"))
    found = seeds(keyed, window, gram)
    twice = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), (F.min("stretch") != F.max("stretch")).alias("mixed")).where("_n > 1").select("anchor", "mixed"))
    met = materialize(found.join(twice, "anchor"))
    kinds = materialize(met.where("mixed").groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("_n"), F.min("row_key").alias("_row"), F.min_by("place", "row_key").alias("_place")))
    # What to do with an occurrence: 0 remove all its windows; 1 compare them; 2 as 0, and compare others with them.
    role = F.when(F.col("_n") == 1, 1).when((F.col("row_key") == F.col("_row")) & (F.col("place") == F.col("_place")), 2).otherwise(0)
    roles = met.where("NOT mixed").select("row_key", "place", F.lit(0).alias("role")).union(met.where("mixed").join(kinds, ["anchor", "stretch"]).select("row_key", "place", role.alias("role")))
    second = F.expr(f"shiftright(place, {SPAN_BITS + WORD_BITS})").alias("second")
    per_row = materialize(roles.groupBy("row_key", second).agg(*(F.collect_set(F.when(c, F.col("place"))).alias(name) for name, c in (("sure", F.col("role") != 1), ("ask", F.col("role") == 1), ("show", F.col("role") == 2)))))

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            rows, keep = [], []
            for k, (value, sure, ask, show) in enumerate(zip(batch.column(3), *(batch.column(c).to_pylist() for c in (4, 5, 6)))):
                rows.append((None,) * 3 if ask else _outcome((value.as_py() or "").encode("utf-8", "surrogatepass"), window, sure or (), digest))
                keep.append(k if ask or show else None)
            cols = list(zip(*rows))
            text = batch.column(3).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2, 4, 5, 6)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))), text], names=[*(batch.schema.names[c] for c in (0, 1, 2, 4, 5, 6)), "n_words", "n_removed", "kept", "text"])

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    long_lists = "sure array<long>, ask array<long>, show array<long>"
    joined = keyed.join(per_row, ["row_key", "second"], "left").select("doc_id", "row_key", "second", "text", "sure", "ask", "show")
    looked = materialize(joined.mapInArrow(first_look, f"doc_id {id_type}, row_key long, second long, {long_lists}, n_words long, n_removed long, kept string, text string"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[*((p, True) for p in a or ()), *((p, False) for p in s or ())] for a, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            for first, flat, at in runs(batch.column(2)):
                words = Words(flat, at)
                rows, starts, asked = [], [], []
                for d in range(len(at) - 1):
                    for place, ask in lists[first + d]:
                        low, more = _unpack(place)
                        starts.append(np.arange(low, low + more + 1) + words.first[d])
                        rows.append(np.full(more + 1, d))
                        asked.append(np.full(more + 1, ask))
                if not rows:
                    continue
                row, start, ask = map(np.concatenate, (rows, starts, asked))
                two = [signed(Sequences(words.hashes(h), h).of(start, start + window)) for h in (0, 1)]
                row_key, number = batch.column(0).to_numpy()[first + row], batch.column(1).to_numpy()[first + row]
                place = (number << (SPAN_BITS + WORD_BITS)) | ((start - words.first[row]) << SPAN_BITS)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*two, row_key, place, ask))], names=["w1", "w2", "row_key", "place", "asked"])

    pending = looked.where("text IS NOT NULL")
    # Repeated rows have equal places; they are one here, as in their lists.
    compared = pending.dropDuplicates(["row_key", "second"]).select("row_key", "second", "text", "ask", "show").mapInArrow(windows, "w1 long, w2 long, row_key long, place long, asked boolean")
    compared = materialize(compared)
    repeated = materialize(compared.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    more = compared.where("asked").join(repeated, ["w1", "w2"]).groupBy("row_key", second).agg(F.collect_set("place").alias("more"))

    def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [_outcome(t.as_py().encode("utf-8", "surrogatepass"), window, [*(s or ()), *(m or ())], digest) for t, s, m in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept"])

    rest = looked.where("kept IS NULL").join(more, ["row_key", "second"], "left").select("doc_id", "text", "sure", "more").mapInArrow(second_look, f"doc_id {id_type}, n_words long, n_removed long, kept string")
    return looked.where("kept IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept").union(rest).withColumnRenamed("doc_id", id_col)
