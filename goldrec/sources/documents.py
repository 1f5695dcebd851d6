"""Text of resume files as rows of blocks. DOCX is read with the standard library; PDF takes an extractor of the user's."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.functions.text import strip
from goldrec.sources.files import file_error, read_files

LEAST_TEXT = 10
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: From a file's bytes: (page, text, is isolated) in reading order.
Extractor = Callable[[bytes], list[tuple[int, str, bool]]]


def docx_blocks(raw: bytes) -> list[tuple[int, str, bool]]:
    """Paragraphs of the body, cells of its tables, headers and footers; list paragraphs begin with a bullet."""

    def text(p) -> str:
        plain = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        listed = p.find(f"{W}pPr/{W}numPr") is not None or style is not None and style.get(f"{W}val", "").startswith("List")
        return f"• {plain}" if plain and listed else plain

    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        out = [(0, text(p), True) for p in body.findall(f"{W}p")]
        out += [(0, " ".join(filter(None, map(text, c.iter(f"{W}p")))), False) for c in body.iter(f"{W}tc")]
        for name in sorted(n for n in archive.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")):
            out += [(0, text(p), False) for p in ElementTree.fromstring(archive.read(name)).iter(f"{W}p")]
    return [b for b in out if b[1]]


def read_documents(spark: SparkSession, path: str, pdf: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) of the .docx and .pdf files below a path; a file at a time is in memory, 5 MiB at most."""
    return from_files(read_files(spark, path), pdf)


def from_files(files: DataFrame, pdf: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """The same from rows (path, length, content). A file without any text is a reject too."""
    kind, message = file_error((".docx", ".pdf"))
    files = files.withColumns({"error_type": kind, "error_message": message})

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["path"], frame["content"]):
                read = docx_blocks if name.lower().endswith(".docx") else pdf
                try:
                    if read is None:
                        raise ValueError("no PDF extractor was given")
                    found = read(bytes(raw))
                    if not found:
                        raise ValueError("too little text")
                    rows += [(name, page, i, line, alone, None) for i, (page, line, alone) in enumerate(found)]
                except Exception as error:  # a broken file is a reject
                    rows.append((name, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "ord", "text", "is_isolated", "error_message"])

    read = files.where("error_type IS NULL").select("path", "content").mapInPandas(over, "doc_id string, page_index int, ord int, text string, is_isolated boolean, error_message string")
    sizes = read.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("text")))).alias("n"), F.max("error_message").alias("error_message"))
    short = sizes.where(f"error_message IS NOT NULL OR n < {LEAST_TEXT}").select("doc_id", F.lit("TextExtractionError").alias("error_type"), F.coalesce("error_message", F.lit("too little text")).alias("error_message"))
    gated = files.where("error_type IS NOT NULL").select(F.col("path").alias("doc_id"), "error_type", "error_message")
    return read.where("error_message IS NULL").drop("error_message").join(short.select("doc_id"), "doc_id", "left_anti"), gated.unionByName(short)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Blocks of texts that are extracted already: a line a block, none of them isolated."""
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("ord", "text"), F.lit(False).alias("is_isolated"))
