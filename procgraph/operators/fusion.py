"""Rank fusion and list merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import first_per

#: Fixed value: damping of reciprocal ranks.
RRF_K = 60


def ranked(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """Rank from 1 per query by score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= keep) if keep else out


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = RRF_K, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank) by the sum of weight / (rrf_k + rank)
    over lists (query_id, id, rank).

    The full outer join is a union and one aggregate: one shuffle for any number
    of lists, and each list's rows are added before it.
    """
    parts = [
        rows.select("query_id", "id", (F.lit(float(w)) / (F.lit(rrf_k) + F.col("rank"))).alias("s")) for rows, w in lists
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))
    return ranked(fused, k)


def multi_signal(vector: DataFrame, bm25: DataFrame, boost: DataFrame | None, k: int, rrf_k: int = RRF_K, weight: float = 0.1) -> DataFrame:
    """L4: vector and BM25 ranks fused, plus weight * max(0, boost), with the
    signals beside the score.  boost: (query_id, id, boost)."""
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = bm25.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = v.join(b, ["query_id", "id"], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(term("vector_rank") + term("bm25_rank"), 9))
    if boost is not None:
        both = both.join(boost, ["query_id", "id"], "left")
    else:
        both = both.withColumn("boost", F.lit(None).cast("double"))
    extra = F.greatest(F.lit(0.0), F.coalesce("boost", F.lit(0.0)))
    out = both.withColumn("keyword_boost", extra).drop("boost")
    out = out.withColumn("score", F.round(F.col("rrf_score") + F.lit(weight) * F.col("keyword_boost"), 9))
    return ranked(out.na.fill(0.0, ["vector_score", "bm25_score"]), k)


def interleave(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """Graph 1, vector 1, graph 2, ...; an id counts at its first place."""
    both = ranked(graph).select("query_id", "id", "score", "rank", F.lit(0).alias("src")).unionByName(
        ranked(vector).select("query_id", "id", "score", "rank", F.lit(1).alias("src"))
    )
    once = first_per(both, ["query_id", "id"], [F.col("rank"), F.col("src")])
    w = Window.partitionBy("query_id").orderBy("rank", "src")
    return once.select("query_id", "id", "score", F.row_number().over(w).alias("place"))


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the earlier part wins a key."""
    union = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        union = p if union is None else union.unionByName(p, allowMissingColumns=True)
    return first_per(union, keys, [F.col("_part")]).drop("_part")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which new rows replace old ones of their key."""
    return first_wins([new, old], keys)


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in seen."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def source_floor(score: Column, source_type: Column, graph: float = 0.25, vector: float = 0.40) -> Column:
    """Relevance floors by source class; a missing score passes."""
    floor = F.when(source_type == "vector_supplement", vector).otherwise(graph)
    return score.isNull() | (score >= floor)
