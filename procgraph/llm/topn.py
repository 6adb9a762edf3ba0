"""Top N items within every group (problem 5).

Method: partition lower bounds.  The N-th best item that any part of the rows
holds for a group is a valid lower bound of the group's N-th best; rows below
the greatest bound of their group are filtered before the shuffle, and only the
survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, filled, materialize

#: More bounds than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_BOUNDS = 200_000


def scored_entries(df: DataFrame, group: str, items: str, scores: str) -> DataFrame:
    """(g, item, score) of arrays with the same positions.  Entries without item
    or score (missing, null, NaN) and rows without group are left out."""
    pairs = F.arrays_zip(F.col(f"`{items}`").alias("item"), F.col(f"`{scores}`").alias("score"))
    return (
        df.where(F.col(f"`{group}`").isNotNull())
        .select(F.col(f"`{group}`").alias("g"), F.explode(pairs).alias("e"))
        .select("g", F.col("e.item").alias("item"), F.col("e.score").cast("double").alias("score"))
        .where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    )


def lower_bounds(entries: DataFrame, n: int) -> DataFrame:
    """(g, bound): the greatest N-th best (score, item) that a batch of rows has
    of a group.  Groups with fewer than n items in every batch have no bound."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count = pdf["g"].value_counts()
            hot = pdf[pdf["g"].isin(count.index[count >= 4 * n])]
            if hot.empty:
                continue
            best = hot.sort_values(["score", "item"], ascending=[False, True]).drop_duplicates(["g", "item"])
            nth = best[best.groupby("g").cumcount() == n - 1]
            yield nth[["g", "item", "score"]]

    found = entries.mapInPandas(filled(local), entries.schema)
    # Greatest bound: highest score, then smallest item; min over (-score, item).
    return found.groupBy("g").agg(F.min(F.struct((-F.col("score")).alias("s"), "item")).alias("bound"))


def top_n(entries: DataFrame, n: int) -> DataFrame:
    """(g, item, score, rank) of the n best items of every group of (g, item,
    score) rows.

    An item that occurs more often counts once, with its highest score; equal
    scores go to the smaller item.  Ties therefore never widen the result, and a
    group of millions of equal scores is cut by its bound like any other.
    Groups with fewer than n items give all of them; an empty input gives none.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    bounds = materialize(lower_bounds(entries, n))
    kept = (
        entries.join(broadcast_if_small(bounds, MAX_BROADCAST_BOUNDS), "g", "left")
        .where(F.col("bound").isNull() | (F.struct((-F.col("score")).alias("s"), "item") <= F.col("bound")))
        .groupBy("g", "item")
        .agg(F.max("score").alias("score"))
    )
    w = Window.partitionBy("g").orderBy(F.desc("score"), "item")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
