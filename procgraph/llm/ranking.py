"""One ranking from several differently scaled scores (problem 6).

Method: robust rank aggregation.  Each item's normalised ranks are sorted, the
probability of each under the uniform null model (a beta order statistic) is
evaluated, the smallest is corrected for the number of scores, and items are
ranked by that significance.  Only ranks enter, so no score can decide alone
because its numbers are large.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

#: A group with more rows than this is ranked in value buckets, each of its own task.
HOT_ROWS = 20_000
#: Most buckets of a hot group.
MOST_CUTS = 4096


def _clean(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def merged_scores(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(g, item, s0, s1, ...): an item listed more than once in a group counts
    once, with the best value of each score; NaN counts as missing.  Rows
    without group or item are left out."""
    return (
        df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{item}`").isNotNull())
        .select(
            F.col(f"`{group}`").alias("g"),
            F.col(f"`{item}`").alias("item"),
            *[_clean(s).alias(f"s{i}") for i, s in enumerate(scores)],
        )
        .groupBy("g", "item")
        .agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(scores))])
    )


def score_ranks(rows: DataFrame, n_scores: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds n (items of the group) and r0, r1, ...: 1 + the number of items with
    a better score, ties sharing the rank; a missing score has rank n.

    Groups of up to hot_rows items are ranked by windows over one shuffle by
    group.  Larger ones are cut at quantiles of their values (a mergeable
    sketch), the more cuts the more items, ranked bucket by bucket and shifted by
    the sizes of the better buckets, so no task sorts a whole hot group.  Items
    of one value share a bucket and a rank.
    """
    rows = materialize(rows)
    counts = materialize(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows))
    most = counts.agg(F.max("n")).first()[0]
    group = Window.partitionBy("g")
    hot = broadcast_if_small(counts, 100_000) if most else counts
    cold = (rows.join(hot, "g", "left_anti") if most else rows).withColumn("n", F.count("*").over(group))
    cold = cold.withColumns(
        {
            f"r{i}": F.when(F.col(f"s{i}").isNull(), F.col("n")).otherwise(F.rank().over(group.orderBy(F.desc_nulls_last(f"s{i}")))).cast("long")
            for i in range(n_scores)
        }
    )
    if not most:
        return cold
    pieces = min(MOST_CUTS, 2 * -(-most // hot_rows))
    return cold.unionByName(_bucket_ranks(rows.join(hot, "g"), n_scores, pieces))


def _bucket_ranks(rows: DataFrame, n_scores: int, pieces: int) -> DataFrame:
    """score_ranks of hot groups; rows has n already."""
    s = [f"s{i}" for i in range(n_scores)]
    grid = [i / pieces for i in range(1, pieces)]
    cuts = rows.groupBy("g").agg(*[F.percentile_approx(c, grid, max(2000, 10 * pieces)).alias(f"c{c}") for c in s])
    long = rows.select("g", "item", F.posexplode(F.array(*s)).alias("which", "value"))
    cut_long = materialize(
        cuts.select("g", F.posexplode(F.array(*[f"c{c}" for c in s])).alias("which", "cuts")).where("cuts is not null")
    )
    given = long.where("value is not null").join(broadcast_if_small(cut_long, 5_000_000 // pieces), ["g", "which"], "left")
    # Bucket 0 holds the best values; equal values always share a bucket.
    given = given.withColumn(
        "bucket", F.coalesce(F.size(F.filter("cuts", lambda c: c > F.col("value"))), F.lit(0))
    ).drop("cuts")
    # Equal values are counted before they are shuffled, so one value is one row of its bucket.
    values = given.groupBy("g", "which", "bucket", "value").agg(F.count("*").alias("times"))
    sizes = materialize(values.groupBy("g", "which", "bucket").agg(F.sum("times").alias("size")))
    before = Window.partitionBy("g", "which").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("better", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy("g", "which", "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        values.withColumn("inner", F.coalesce(F.sum("times").over(inside), F.lit(0)) + 1)
        .join(broadcast_if_small(offsets, 200_000), ["g", "which", "bucket"])
        .select("g", "which", "value", (F.col("inner") + F.col("better")).alias("r"))
    )
    wide = (
        long.where("value is not null")
        .join(ranks, ["g", "which", "value"])
        .groupBy("g", "item")
        .agg(*[F.max(F.when(F.col("which") == i, F.col("r"))).alias(f"r{i}") for i in range(n_scores)])
    )
    out = rows.join(wide, ["g", "item"], "left")
    return out.withColumns({f"r{i}": F.coalesce(F.col(f"r{i}"), F.col("n")).cast("long") for i in range(n_scores)})


def beta_tail(x: Column, k: int, n: int) -> Column:
    """P(the k-th smallest of n uniform values <= x), as a polynomial in x."""
    terms = [F.lit(float(comb(n, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(n - j)) for j in range(k, n + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def aggregate_ranks(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(g, item, s*, n, r*, rho, log_p, mean_rank): with p the smallest
    order-statistic probability of an item's ranks, rho = min(1, number of
    scores * p) and log_p = ln p to 9 digits.

    Order by log_p, mean_rank, item: an item that is worse on every score always
    comes later.  Groups of one item have rho = 1.  Empty input gives none.
    """
    m = len(scores)
    ranked = score_ranks(merged_scores(df, group, item, scores), m, hot_rows)
    norm = F.array_sort(F.array(*[F.col(f"r{i}") / F.col("n") for i in range(m)]))
    out = ranked.withColumn("u", norm)
    out = out.withColumn("p", F.least(*[beta_tail(F.col("u")[k - 1], k, m) for k in range(1, m + 1)]))
    mean = F.round(sum((F.col(f"r{i}") for i in range(1, m)), F.col("r0")) / F.lit(m), 9)
    return out.withColumns(
        {"rho": F.least(F.lit(1.0), F.col("p") * m), "log_p": F.round(F.log("p"), 9), "mean_rank": mean}
    ).drop("u", "p")


def first_ranked(aggregated: DataFrame, k: int) -> DataFrame:
    """The first k of every group's ranking, with place 1..k.  The limit is
    applied inside each input partition before the shuffle."""
    w = Window.partitionBy("g").orderBy("log_p", "mean_rank", "item")
    return aggregated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def full_ranking(aggregated: DataFrame) -> DataFrame:
    """place of every item in its group.

    Rows are range-partitioned by group and order, so that a hot group spreads
    over many tasks; places are local positions plus the group's rows in earlier
    partitions.  The ranged rows are written once, since both passes must see the
    same partition limits.
    """
    ranged = aggregated.repartitionByRange("g", "log_p", "mean_rank", "item").sortWithinPartitions(
        "g", "log_p", "mean_rank", "item"
    )
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    starts = ranged.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("earlier", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return (
        ranged.withColumn("part", part)
        .join(starts, ["g", "part"])
        .withColumn("place", F.col("at") - F.col("first") + F.col("earlier") + 1)
        .drop("at", "first", "earlier", "part")
    )


def certain_first(aggregated: DataFrame, k: int, n_scores: int) -> DataFrame:
    """(g, item) of results in the first k of the ranking for which fewer than k
    other results are as good or better on any score.

    Exact check after the ranking.  It compares the first places with the k + 1
    best rows on each score, ties cut anyhow: if fewer than k others are as good
    on a score, all of them are among its k best, else the k + 1 best hold k of them.
    """
    r = [f"r{i}" for i in range(n_scores)]
    aggregated = materialize(aggregated.select("g", "item", "log_p", "mean_rank", *r))
    best = Window.partitionBy("g", "which").orderBy("rank", "other")
    vector = [F.col(c).alias(f"o{c}") for c in r]
    front = (
        aggregated.select("g", F.col("item").alias("other"), *vector, F.posexplode(F.array(*r)).alias("which", "rank"))
        .withColumn("t", F.row_number().over(best))
        .where(F.col("t") <= k + 1)
        .select("g", "other", *[f"o{c}" for c in r])
        .distinct()
    )
    top = first_ranked(aggregated, k).select("g", "item", *r)
    as_good = F.lit(False)
    for c in r:
        as_good = as_good | (F.col(f"o{c}") <= F.col(c))
    rivals = F.count(F.when((F.col("other") != F.col("item")) & as_good, 1))
    return top.join(front, "g", "left").groupBy("g", "item").agg(rivals.alias("rivals")).where(F.col("rivals") < k)
