"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions are tried only where it has hit, and
tokens that carry a checksum are kept only if it holds.

A keyword hit opens an anchored match at that place. Runs of hexadecimal digits have no keyword; they are found by
their own class. Added kinds, after the base ones: `forge` (five prefixes, 30 characters and six of a checksum),
`registry` (`npm_`, 30 and six) and `pem` (a private key block's first line). A null text is an empty one; every text is
read whole; spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from goldrec.llm.common import aside, fresh

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Lower-case keyword -> what to try where it begins.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge",
    "npm_": "registry",
    "-----begin ": "pem",
}
KINDS = ("assign", "access", "hex", "forge", "registry", "pem")

SCHEMA = "n_assign long, n_access long, n_hex long, base_spans string, spans string"


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of the token's body."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text."""
    raw = text.encode("utf-8", "surrogatepass")
    ascii_only = len(raw) == len(text)
    out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    done = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in keywords.iter(raw.lower().decode("latin-1")))
    byte = start = 0
    for at, kind in hits:
        start += at - byte if ascii_only else len(raw[byte:at].decode("utf-8", "surrogatepass"))
        byte = at
        if start < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= 6
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= 20
        elif kind == "pem":
            good = m = PEM.match(text, start)
        else:
            m = CHECKED.match(text, start)
            good = m and checksum(m[1]) == m[2]
        if m:
            done[kind] = m.end()
        if good:
            out.append((kind, start, m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the `keep` columns, counts of the base kinds, base spans and all spans as kind:start:end.

    Narrow: no shuffle; a task works batch by batch. A column in `keep` that is named like
    an output comes out as kept_ and its name.
    """
    import pyspark.sql.functions as F

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            rows = []
            for value in batch.column(0):
                found = scan(value.as_py() or "", keywords)
                count = [sum(k == kind for k, _, _ in found) for kind in KINDS[:3]]
                join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                rows.append((*count, join(x for x in found if x[0] in KINDS[:3]), join(found)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)] if rows else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    kept = aside(docs.select(F.col(text).alias(fresh(docs, "_text")[0]), *keep), "n_assign", "n_access", "n_hex", "base_spans", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(over, f"{schema}, {SCHEMA}")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
