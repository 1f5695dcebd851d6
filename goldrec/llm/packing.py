"""Best-fit packing of tokenized documents into sequences of bounded length.

Planning runs over a histogram of piece lengths (as many numbers as a sequence has tokens), never over documents:
bins that are filled alike form groups, and a length's pieces go, as counts, to the groups they fit best. Pieces then
take the planned places by joining on their rank within their length.

A document is its ids and one end id; only a longer one is cut, into full pieces of `capacity`, the first shorter. A
null text is an empty one (its end id alone). Repeated rows are packed each; an empty table gives no pieces. A text of any
length is encoded whole; it and its ids must fit a task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import materialize, rank_in_groups

CAPACITY = 2048
END_ID = 0

#: The faster encoder's pattern backtracks over a run of white space and overflows its stack in one of a million; texts
#: with a run of this many are left to the library.
BLANKS = 50_000
LONG_BLANK = re.compile(rf"\s{{{BLANKS}}}")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file (the tokenizers library's JSON), equal to that library's.

    `of` takes names of added tokens in a text as ordinary text, at four times that library's speed; `ids` follows the
    library's default settings, by which an added token is its own id: a text that holds one goes to the library itself,
    and so does a text with a very long run of white space, or any other that the faster encoder can't take.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.whole = path, None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in set(self.added)}
        self.of = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if not any(token in text for token in self.added) and not (len(text) >= BLANKS and LONG_BLANK.search(text)):
            try:
                return self.of(text)
            except BaseException as error:  # a panic of the encoder is no Exception
                if type(error).__name__ != "PanicException":
                    raise
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian uint32."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            rows, which = [], []
            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "")
                ids.append(end_id)
                raw = array("I", ids).tobytes()
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(part), part)[: 4 + with_ids])
                    which.append(i)
            cols = list(zip(*rows)) or [()] * (4 + with_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    slim = docs.select(id_col, text)
    return slim.mapInArrow(over, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, bins, pieces a bin, first bin, offset) of a best-fit-decreasing packing.

    Its length depends on the number of different lengths, at most `capacity`, and not on the counts.
    """
    out, bins = [], 0
    rooms: list[int] = []  # sorted: the room left in some group of bins
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                keep(room - full // full * each * length, first, full)
            if full < n:
                last = left if left < each else 0
                if last:
                    out.append((length, rank, 1, last, first + full, capacity - room))
                    rank, left = rank + last, 0
                    keep(room - last * length, first + full, 1)
                keep(room, first + full + bool(last), n - full - bool(last))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`, which are written once to the shared folder."""
    spark = parts.sparkSession
    written = materialize(parts)
    counts = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    planned = F.broadcast(spark.createDataFrame(plan(counts, capacity), "length long, _from long, _bins long, _each long, _first long, _at long"))
    ranked = rank_in_groups(written, ["length"], [id_col, "piece", "ids_crc32"], bounded_groups=True, name="_rank")
    return (
        ranked.join(planned, "length")
        .where("_rank >= _from AND _rank < _from + _bins * _each")
        .withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
        .withColumn("offset", F.expr("_at + (_rank - _from) % _each * length"))
        .drop("_rank", "_from", "_bins", "_each", "_first", "_at")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry ids: sequence_id, length, ids (uint32, at most `capacity`)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.expr("aggregate(_parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
