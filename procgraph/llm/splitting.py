"""Splitting oversized texts at natural boundaries (problem 1).

Method: balanced targets.  The minimum number of pieces is computed, equally
long targets are placed, each is snapped to the strongest boundary near it, and
a piece is added whenever a limit would be broken or a cut would miss the only
boundaries that a piece can end at.
"""

from __future__ import annotations

from collections.abc import Iterator
from bisect import bisect_left, bisect_right

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..session import filled

#: Ends at which white space does not count.
EDGE = " \t\r\n"

#: Boundaries, strongest first.  A cut is placed at the end of a match.
BOUNDARIES = tuple(
    regex.compile(p)
    for p in (
        r"\n[ \t\r]*\n\s*",  # paragraph
        r"\n\s*",  # line
        r"[.!?…][\"'”’)\]]*\s+|[。！？；][”’」』）]*\s*",  # sentence
        r"[,;:]\s+|[，、：]",  # clause
        r"\s+",  # word
    )
)
CLUSTER = regex.compile(r"\X")


def trimmed(c: Column) -> Column:
    """The text without spaces, tabs and line breaks at both ends."""
    return F.trim(c, F.lit(EDGE))


def split_points(text: str, limit: int, overlap: int, reach: float = 0.35) -> list[tuple[int, int]]:
    """(start, end) of each piece of text: at most limit characters, each piece
    beginning exactly overlap characters before the end of the one before.

    A cut never falls inside a grapheme cluster unless one cluster is longer
    than a piece may be.  reach: how far a target may move, as a share of the
    step between two targets.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    levels = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    inner = None
    if regex.search(r"\X{1}(?<=[\p{M}‍️‌\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF])|\r\n", text):
        inner = set()
        for m in CLUSTER.finditer(text):
            inner.update(range(m.start() + 1, m.end()))
    k = -(-(n - overlap) // step)
    while True:
        cuts = _snap(n, k, limit, overlap, reach, levels, inner)
        if cuts is not None:
            break
        k += 1
    starts = [0] + [c - overlap for c in cuts]
    return list(zip(starts, cuts + [n]))


def _strongest(low, high, target, overlap, levels, inner):
    """The boundary in low..high nearest to the target, of the strongest kind there."""
    for ends in levels:
        best = None
        for e in ends[bisect_left(ends, low) : bisect_right(ends, high)]:
            bad = 0
            if inner:
                if e in inner:
                    continue
                bad = int((e - overlap) in inner)
            key = (bad, abs(e - target), e)
            if best is None or key < best:
                best = key
        if best is not None:
            return best[2]
    return None


def _snap(n, k, limit, overlap, reach, levels, inner):
    """At most k-1 cuts near balanced targets, or None if a piece gets too long or
    would be cut hard although one more piece lets it end at a boundary."""
    cuts: list[int] = []
    start = 0
    for i in range(1, k):
        left = k - i  # pieces still to come
        # The next end must leave this piece within the limit and the rest feasible.
        most = min(start + limit, n - 1)
        least = max(start + overlap + 1, n - left * (limit - overlap))
        if least > most:
            if n - start <= limit:
                break  # nothing is left for the pieces still to come
            return None
        # Balanced over what is left, so that one moved cut doesn't unbalance the rest.
        ideal = (n - start - overlap) / (left + 1)
        target = start + overlap + ideal
        low, high = max(least, int(target - reach * ideal)), min(most, int(target + reach * ideal))
        if low > high:
            low = high = min(max(int(target), least), most)
        cut = _strongest(low, high, target, overlap, levels, inner)
        if cut is None:
            cut = _strongest(least, most, target, overlap, levels, inner)
        if cut is None and _strongest(start + overlap + 1, most, target, overlap, levels, inner) is not None:
            return None
        if cut is None:
            at = min(max(round(target), low), high)
            around = sorted(range(low, high + 1), key=lambda e: abs(e - at)) if inner else [at]
            clean = [e for e in around if e not in inner and (e - overlap) not in inner] if inner else around
            whole = clean or ([e for e in around if e not in inner] if inner else [])
            cut = (whole or around)[0]
        cuts.append(cut)
        start = cut - overlap
    return cuts if n - start <= limit else None


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int = 500, overlap: int = 50, version: str | None = None
) -> DataFrame:
    """Pieces of every text of df that is longer than limit code points.

    Columns: key, piece_index, n_pieces, char_start, char_end, piece.  Offsets
    count in the text without white space at its ends.  Texts within the limit,
    null and blank texts give no row: they are used whole.  Rows with the same
    key count once, the one with the greatest version (then the greatest text)
    winning; each row with a null key counts by itself.

    Short texts are dropped in the JVM, before anything is shuffled or sent to
    Python; other columns are never read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    body = trimmed(F.col(f"`{text}`"))
    order = F.struct(*([F.col(f"`{version}`").alias("v")] if version else []), body.alias("t"))
    rows = df.where(F.length(body) > limit).select(F.col(f"`{key}`").alias("k"), order.alias("o"))
    keyed = rows.where("k is not null").groupBy("k").agg(F.max("o")["t"].alias("t"))
    long = keyed.unionByName(rows.where("k is null").select("k", F.col("o.t").alias("t")))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                spans = split_points(t, limit, overlap)
                rows += [(k, i, len(spans), a, b, t[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["k", "piece_index", "n_pieces", "char_start", "char_end", "piece"])

    kind = df.schema[key].dataType.simpleString()
    out = long.mapInPandas(filled(pieces), f"k {kind}, piece_index int, n_pieces int, char_start int, char_end int, piece string"
    )
    return out.withColumnRenamed("k", key)
