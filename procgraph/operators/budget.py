"""Greedy prefix budgets as windows.

Token counts are not negative, so a running sum never falls and "stop at the
first overflow" is a filter on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a separator, and of the prompts around a context.
SEPARATOR, ANSWER_OVERHEAD, FINAL_OVERHEAD = 6, 250, 350
GRAPH_SHARE, SUPPLEMENT_SHARE, SUFFICIENT_SHARE = 0.70, 0.35, 0.20


def _running(group: list[str], order: list[Column]):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prefix(rows: DataFrame, group: list[str], order: list[Column], tokens: str, limit: Column | int, separator: int = SEPARATOR) -> DataFrame:
    """W2 (separator 6) and W3 (separator 0): the rows before the first that does
    not fit, with used = tokens so far."""
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    w = _running(group, order)
    used = F.sum(tokens).over(w) + F.lit(separator) * (F.count("*").over(w) - 1)
    return rows.withColumn("used", used).where(F.col("used") <= lim)


def supplement(rows: DataFrame, group: list[str], order: list[Column], tokens: str, limit: Column | int, least: int = 100, rest: int = 50) -> DataFrame:
    """Rows of at least least tokens while they fit; the first that does
    not is cut to what remains, if that is at least rest.  taken = tokens used."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.where(F.col(tokens) >= least)
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    left = lim - F.coalesce(F.sum(tokens).over(before), F.lit(0))
    sized = sized.withColumn("left", left)
    fits = F.col(tokens) <= F.col("left")
    return (
        sized.where((F.col("left") > 0) & (fits | (F.col("left") >= rest)))
        .withColumn("taken", F.least(F.col(tokens), F.col("left")))
        .withColumn("cut", ~fits)
        .drop("left")
    )


def two_tier(rows: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int, share: float = GRAPH_SHARE, rest: int = 100) -> DataFrame:
    """Rows of tier 0 up to share of the budget, then rows of tier 1 up to all
    of it; the boundary row of a tier is cut if more than rest tokens remain."""
    first = int(budget * share)
    w = _running(group + ["tier"], order)
    n, total = F.count("*").over(w), F.sum(tokens).over(w)
    rows = rows.withColumns({"n": n, "total": total})
    zero = rows.where("tier = 0").withColumn("used", F.col("total") + SEPARATOR * (F.col("n") - 1))
    zero = _with_boundary(zero, group, order, tokens, F.lit(first), rest)
    spent = zero.groupBy(*group).agg(F.max("after").alias("spent"))
    one = rows.where("tier = 1").join(spent, group, "left")
    started = F.col("spent").isNotNull()
    one = one.withColumn(
        "used", F.coalesce("spent", F.lit(0)) + F.col("total") + SEPARATOR * (F.col("n") - F.when(started, 0).otherwise(1))
    ).drop("spent")
    one = _with_boundary(one, group, order, tokens, F.lit(budget), rest)
    return zero.unionByName(one).drop("n", "total", "used", "after")


def _with_boundary(rows: DataFrame, group: list[str], order: list[Column], tokens: str, limit: Column, rest: int) -> DataFrame:
    """Rows whose used fits, and the first that does not, cut to what remains."""
    w = Window.partitionBy(*group, "tier").orderBy(*order)
    left = limit - (F.col("used") - F.col(tokens))
    rows = rows.withColumns({"fits": F.col("used") <= limit, "left": left})
    rows = rows.withColumn("prev", F.coalesce(F.lag("fits").over(w), F.lit(True)))
    cut = ~F.col("fits") & F.col("prev") & (F.col("left") > rest)
    return (
        rows.where(F.col("fits") | cut)
        .withColumn("taken", F.when(F.col("fits"), F.col(tokens)).otherwise(F.col("left")))
        .withColumn("cut", ~F.col("fits"))
        .withColumn("after", F.when(F.col("fits"), F.col("used")).otherwise(limit))
        .drop("fits", "left", "prev")
    )


def anchor_budget(limit: int, used: int, anchors_left: int, floor: int = 800, tilt: float = 1.4) -> int:
    """Token limit up to which the next anchor may go."""
    share = max(floor, int((limit - used) / max(anchors_left, 1) * tilt))
    return min(limit, used + share)


def supplement_budget(limit: int, used: Column, sufficient: Column) -> Column:
    """Tokens for the vector supplement; up to 200 it is not run."""
    room = F.least(F.lit(limit) - used, F.lit(int(limit * SUPPLEMENT_SHARE)))
    room = F.when(sufficient & (used > 0), F.least(room, F.lit(int(limit * SUFFICIENT_SHARE)))).otherwise(room)
    return F.when(room > 200, room).otherwise(0)
