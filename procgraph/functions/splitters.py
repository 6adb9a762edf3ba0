"""Text splitters (F1, F2, F5-F7) and the operator that applies one to a table.

Paragraph and fixed-window splitting are native expressions.  The packing
splitters carry state from piece to piece, so they run as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chunk_id, strip
from ..session import filled

#: Where an oversized piece is divided, strongest first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?")
#: What counts as a heading.
HEADING = re.compile(
    r"^(?:#{1,6}\s+.+|第[一二三四五六七八九十\d]+[章节、].+|\d+\.\s+.+|\d+\.\d+\s+.+|[一二三四五六七八九十]+[、.].+)$", re.M
)
#: What ends a sentence; a point inside a number does not.
SENTENCE_END = re.compile(r"[。！？；!?;]|\.(?=\s|$|[^\d\w])")


def paragraphs(text: Column, least: int = 10) -> Column:
    """blank-line paragraphs, else lines, of at least least characters."""
    by_blank = F.split(text, "\n\n", -1)
    parts = F.when(F.size(by_blank) > 1, by_blank).otherwise(F.split(text, "\n", -1))
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) >= least)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """windows of size characters, each starting size - overlap after the last."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    windows = F.transform(starts, lambda i: strip(F.substring(text, i, F.lit(size))))
    return F.filter(windows, lambda w: w != "")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    step = max(1, size - overlap)
    return [w for i in range(0, len(text), step) if (w := text[i : i + size].strip())]


def pack(text: str | None, size: int = 500, overlap: int = 50, separator: str = "\n\n") -> list[str]:
    """pieces between separators, packed up to size, each block after a full
    one starting with the tail of the one before.  A piece beyond size is divided
    at the strongest separator that it holds, else in windows."""
    if not text or not text.strip():
        return []
    blocks: list[str] = []
    held: list[str] = []
    length = 0
    for piece in text.split(separator):
        if len(piece) > size:
            if held:
                blocks.append(separator.join(held))
            held, length = [], 0
            inner = next((s for s in SEPARATORS if s in piece), None)
            blocks += pack(piece, size, overlap, inner) if inner else _windows(piece, size, overlap)
        elif length + len(piece) + len(separator) > size:
            joined = separator.join(held)
            if held:
                blocks.append(joined)
            tail = joined[-overlap:] if overlap else ""
            held = [tail, piece] if tail else [piece]
            length = len(separator.join(held))
        else:
            held.append(piece)
            length += len(piece) + (len(separator) if len(held) > 1 else 0)
    if held:
        blocks.append(separator.join(held))
    return [b.strip() for b in blocks if b.strip()]


def sections(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """a section per heading; what is longer than size, or has no heading, is packed."""
    if not text:
        return []
    starts = [m.start() for m in HEADING.finditer(text)]
    if not starts:
        return pack(text, size, overlap)
    bounds = [0, *starts, len(text)]
    parts = [p for a, b in zip(bounds, bounds[1:]) if (p := text[a:b].strip())]
    return [c for p in parts for c in (pack(p, size, overlap) if len(p) > size else [p])]


def sentences(text: str | None, most: int = 2, least_chars: int = 20, most_chars: int = 300, keep_short: bool = False) -> list[str]:
    """up to most sentences and most_chars characters to a chunk.  Chunks
    below least_chars are dropped, only the last joins the one before (Q-13);
    with keep_short every short chunk joins its predecessor."""
    found: list[str] = []
    for line in (text or "").split("\n"):
        at = 0
        line = line.strip()
        for m in SENTENCE_END.finditer(line):
            body = line[at : m.start()].strip()
            if body or m.group():
                found.append(body + m.group())
            at = m.end()
        if tail := line[at:].strip():
            found.append(tail)
    chunks: list[str] = []
    held: list[str] = []

    def flush(last: bool) -> None:
        joined = "".join(held)
        if len(joined) >= least_chars:
            chunks.append(joined)
        elif (last or keep_short) and chunks and joined:
            chunks[-1] += " " + joined

    for s in found:
        if held and (len(held) >= most or sum(map(len, held)) + len(s) > most_chars):
            flush(False)
            held = []
        held.append(s)
    if held:
        flush(True)
    return chunks


@dataclass(frozen=True)
class Splitter:
    """kind: paragraph, window, sentence, semantic or basic."""

    kind: str = "basic"
    size: int = 500
    overlap: int = 50
    separator: str = "\n\n"
    most_sentences: int = 2
    least_chars: int = 10

    def function(self) -> Callable[[str | None], list[str]]:
        if self.kind == "sentence":
            return lambda t: sentences(t, self.most_sentences, self.least_chars, self.size)
        if self.kind == "semantic":
            return lambda t: sections(t, self.size, self.overlap)
        if self.kind == "basic":
            return lambda t: pack(t, self.size, self.overlap, self.separator)
        raise ValueError(f"unknown splitter: {self.kind}")


def split(docs: DataFrame, keys: list[str], text: str, splitter: Splitter) -> DataFrame:
    """Rows (keys, chunk_index, chunk) of every text; null and blank texts give none."""
    columns = [F.col(f"`{k}`") for k in keys]
    native = {
        "paragraph": lambda c: paragraphs(c, splitter.least_chars),
        "window": lambda c: fixed_windows(c, splitter.size, splitter.overlap),
    }
    if splitter.kind in native:
        parts = native[splitter.kind](F.col(f"`{text}`"))
        return docs.select(*columns, F.posexplode(parts).alias("chunk_index", "chunk"))
    cut = splitter.function()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [cut(t) for t in pdf["_text"]]
            out = pdf[keys].loc[pdf.index.repeat([len(p) for p in parts])].reset_index(drop=True)
            out["chunk_index"] = [i for p in parts for i in range(len(p))]
            out["chunk"] = [c for p in parts for c in p]
            yield out

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    named = docs.select(*columns, F.col(f"`{text}`").alias("_text"))
    return named.mapInPandas(filled(apply), f"{kinds}, chunk_index int, chunk string")


def chunks_of_files(files: DataFrame, splitter: Splitter) -> DataFrame:
    """(id, text, source_file, chunk_index, tg_id, file_path) of whole-file
    rows (file_path, source_file, tg_id, text)."""
    cut = split(files, ["file_path", "source_file", "tg_id"], "text", splitter)
    return cut.select(
        chunk_id(F.col("source_file"), F.col("chunk_index")).alias("id"),
        F.col("chunk").alias("text"),
        "source_file",
        "chunk_index",
        "tg_id",
        "file_path",
    )
