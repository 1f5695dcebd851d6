"""Words and word sequences of whole Arrow batches of texts, hashed with numpy: no loop over words.

A hash is a polynomial in the bytes (or in the hashes of the words) modulo 2**64, taken from running sums, then
mixed. A second base gives 128 bits where results depend on equality alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about so many bytes, which bounds a worker's memory; a longer text is a run of its own.
RUN_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEQUENCE_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(b: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(base), table(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least `size`."""
    return _powers(base, 1 << max(20, int(size).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in the bytes) for consecutive rows; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + run_bytes, "right")) - 1)
        yield first, flat[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def slices(batch: pa.RecordBatch, text: int, most: int = 4 * RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about so many bytes of text, so that what is made from them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(batch):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words of some texts: byte spans, the number of the first word of each text, hashes."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, lower: bool = False):
        self.flat = LOWER[flat] if lower else flat
        inside = np.zeros(len(flat) + 2, bool)
        inside[1:-1] = ~SPACE[flat]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = at[1:] > at[:-1]
        heads, tails = at[:-1][full], at[1:][full] - 1
        begins[heads], ends[tails] = inside[1:-1][heads], inside[1:-1][tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = powers(BASES[which], len(self.flat) + 1)
        sums = np.zeros(len(self.flat) + 1, np.uint64)
        np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * up[: len(self.flat)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def count_words(texts: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    return np.concatenate([np.zeros(0, np.int64), *(Words(flat, at).counts for _, flat, at in runs(texts))])


class Sequences:
    """Hashes of any stretches of consecutive words."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        n = len(hashes)
        self.up, self.down = powers(SEQUENCE_BASES[which], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
