"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images and written as NPY
tiles with difference hashes.

All of it runs batch by batch inside tasks; nothing is shuffled. Undecodable or null bytes give a row with null
height, width, tile and hash (`decode_media`); a text is stored as a grey image 64 samples wide (`store_texts`). Columns that
aren't named in `keep` are left out; one that is named like an output comes out as kept_ and its name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.common import aside, fresh

#: Width of a stored text; payloads are padded with bytes 0 to a positive multiple of it.
WIDTH = 64
#: A difference hash compares neighbours in a grid of this many rows and one column more.
GRID = 8


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary greyscale Netpbm of a (height, width) array of bytes."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a (height, width, 3) array of bytes, RGB."""
    h, w = image.shape[:2]
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def _netpbm_header(raw: bytes, numbers: int) -> tuple[list[int], int]:
    """The header's numbers, comments skipped, and where the samples begin."""
    found, at = [], 2
    while len(found) < numbers:
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
        elif raw[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while raw[end : end + 1].isdigit():
                end += 1
            found.append(int(raw[at:end]))
            at = end
    return found, at + 1


def _netpbm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    (w, h, *top), at = _netpbm_header(raw, 2 if kind in (1, 4) else 3)
    planes = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits).astype(np.uint8) * 255
    if kind == 1:
        digits = np.frombuffer(raw[at - 1 :], np.uint8)
        return ((49 - digits[(digits == 48) | (digits == 49)][: w * h].astype(int)) * 255).astype(np.uint8).reshape(h, w)
    if kind in (2, 3):
        samples = np.array(raw[at - 1 :].split()[: w * h * planes], np.int64)
    else:
        samples = np.frombuffer(raw, ">u2" if top[0] > 255 else np.uint8, w * h * planes, at)
    if top[0] != 255:
        samples = samples.astype(np.int64) * 255 // top[0]
    return samples.astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(raw: bytes) -> np.ndarray:
    begin, size, w, h, _, bits, packed = *struct.unpack_from("<I", raw, 10), *struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24, 32) or w <= 0:
        raise ValueError("unsupported BMP")
    rows = np.frombuffer(raw, np.uint8, abs(h) * ((w * bits + 31) // 32 * 4), begin).reshape(abs(h), -1)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, 1024 if begin >= 14 + size + 1024 else begin - 14 - size, 14 + size).reshape(-1, 4)
        return palette[rows[:, :w]][:, :, 2::-1]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(raw: bytes | None) -> np.ndarray | None:
    """(height, width) or (height, width, 3) bytes of a Netpbm (P1 to P6) or BMP (8, 24, 32 bits) file; else None."""
    try:
        if raw and raw[:1] == b"P" and raw[1:2] in b"123456":
            return _netpbm(raw)
        if raw and raw[:2] == b"BM":
            return _bmp(raw)
    except (ValueError, IndexError, struct.error, TypeError, ZeroDivisionError, OverflowError):
        return None
    return None


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, fractional borders included, from one integral image: exact at any ratio.

    Only the rows of the integral image at the borders of output rows are made, strip by strip, so that a tall image
    needs no table of its own size.
    """
    h, w = image.shape[:2]
    across, down = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    low = np.minimum(down.astype(int), h - 1)
    needed = np.unique(np.concatenate([[0], low, low + 1]))
    sums = np.zeros((len(needed), w + 1, *image.shape[2:]))
    for k in range(1, len(needed)):
        sums[k, 1:] = sums[k - 1, 1:] + image[needed[k - 1] : needed[k]].sum(0, dtype=np.float64)
    sums = sums.cumsum(1)

    def at(axis: int, low: np.ndarray, part: np.ndarray, table: np.ndarray) -> np.ndarray:
        part = part.reshape([-1 if i == axis else 1 for i in range(table.ndim)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    left = np.minimum(across.astype(int), w - 1)
    corners = at(1, left, across - left, at(0, np.searchsorted(needed, low), down - low, sums))
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: is a cell of the 8 x 9 area means brighter than its left neighbour?"""
    cells = resize(image, GRID, GRID + 1)
    cells = np.round(cells if image.ndim == 2 else cells @ np.array([0.299, 0.587, 0.114]), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def from_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def decode_media(files: DataFrame, content: str = "content", keep: tuple[str, ...] = (), tile: int | None = None) -> DataFrame:
    """One row per file: the `keep` columns, height, width, the NPY tile (resized to tile x tile if given), dhash."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                image = decode(value.as_py())
                if image is None or not image.size:
                    rows.append((None,) * 4)
                    continue
                kept = np.clip(np.round(resize(image, tile, tile)), 0, 255).astype(np.uint8) if tile else image
                rows.append((*image.shape[:2], to_npy(kept), difference_hash(image)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], names=[*batch.schema.names[1:], "height", "width", "tile", "dhash"])

    kept = aside(files.select(F.col(content).alias(fresh(files, "_content")[0]), *keep), "height", "width", "tile", "dhash")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(over, f"{schema}height int, width int, tile binary, dhash string")


def text_image(raw: bytes) -> bytes:
    """A text's bytes as a binary greyscale image 64 samples wide, padded with bytes 0."""
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH))


def store_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_tile: bool = True) -> DataFrame:
    """Stores each whole text (null: empty) as an NPY tile and reads it back.

    Returns the `keep` columns, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (last 64 bytes) of
    the samples read back, media_bytes and media_sha256 of the stored tile, feature (difference hash), and the tile.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["tile"] * with_tile
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_tile

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                stored = to_npy(decode(text_image(raw)))
                image = from_npy(stored)
                payload = image.tobytes()
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), stored)[: len(names)])
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*batch.schema.names[1:], *names])

    kept = aside(docs.select(F.col(text).alias(fresh(docs, "_text")[0]), *keep), *names)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(over, f"{schema}n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", tile binary" * with_tile)
