"""Structural node vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, normalized
from .graph import rings


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector per key; partial sums of whole vectors are shuffled, not
    one row per position.  Missing vectors do not count."""
    given = rows.where(F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return given.groupBy(*keys).agg(mean.alias("m")).select(*keys, vector_to_array("m").alias("v"))


def add(a: Column, b: Column, factor: Column | float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(factor))


def residual_vectors(base: DataFrame, edges: DataFrame, gamma: float = 0.5, hops: int = 2) -> DataFrame:
    """(name, v) with v = norm(e + sum over d of gamma^d * mean vector of the
    ring at distance d); a sum of norm <= 1e-10 falls back to norm(e).

    base is (name, v), one row per node; ring members without vector are left out.
    """
    if not 0 < gamma <= 1:
        raise ValueError("gamma must be above 0 and at most 1")
    if hops < 1:
        raise ValueError("hops must be at least 1")
    own = base.select("name", F.col("v").cast("array<double>").alias("e"))
    near = rings(edges, base.select("name"), hops)
    members = near.join(own, "name").select(F.col("start").alias("name"), "hop", "e")
    means = mean_vector(members, ["name", "hop"], "e")
    weight = F.pow(F.lit(float(gamma)), F.col("hop"))
    total = Summarizer.sum(array_to_vector("v"), weight)
    ring_vec = means.groupBy("name").agg(total.alias("m")).select("name", vector_to_array("m").alias("r"))
    joined = own.join(ring_vec, "name", "left").withColumn("h", F.when(F.col("r").isNull(), F.col("e")).otherwise(add(F.col("e"), F.col("r"))))
    return joined.select("name", F.when(norm(F.col("h")) > 1e-10, normalized(F.col("h"))).otherwise(normalized(F.col("e"))).alias("v"))


def context_text(nodes: DataFrame, edges: DataFrame, most: int = 3, size: int = 512) -> DataFrame:
    """(name, context): the first predecessors and successors, labelled."""
    def side(key: str, other: str, label: str, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("ord", other)
        top = edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("k", other))), lambda s: s[other])
        return top.groupBy(F.col(key).alias("name")).agg(F.concat(F.lit(label), F.array_join(listed, ", ")).alias(name))

    both = nodes.select("name").distinct()
    both = both.join(side("dst", "src", "after: ", "p"), "name", "left").join(side("src", "dst", "before: ", "s"), "name", "left")
    text = F.concat_ws("; ", "p", "s")
    return both.select("name", F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text).alias("context"))


def weighted_vectors(name_vec: DataFrame, context_vec: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - weight) * e(name) + weight * e(context), normalized; a node
    without context keeps its own vector."""
    j = name_vec.select("name", F.col("v").cast("array<double>").alias("e")).join(
        context_vec.select("name", F.col("v").cast("array<double>").alias("c")), "name", "left"
    )
    mixed = F.zip_with("e", "c", lambda x, y: x * (1 - weight) + y * weight)
    return j.select("name", normalized(F.when(F.col("c").isNull(), F.col("e")).otherwise(mixed)).alias("v"))


def embed_nodes(base: DataFrame, edges: DataFrame, method: str = "residual", context_vec: DataFrame | None = None, **kw) -> DataFrame:
    """Vectors of all nodes by one plan per method."""
    if method == "residual":
        return residual_vectors(base, edges, **kw)
    if method == "plain":
        return base.select("name", normalized(F.col("v")).alias("v"))
    if method == "weighted":
        return weighted_vectors(base, context_vec, **kw)
    raise ValueError(f"unknown method: {method}")


def embed_new_nodes(old: DataFrame, base: DataFrame, edges: DataFrame, gamma: float = 0.5, hops: int = 2) -> DataFrame:
    """Vectors after an update: nodes without vector and everything within
    hops of them are computed again, the rest is kept (Q-11 fixed)."""
    new = base.join(old, "name", "left_anti").select("name")
    dirty = new.unionByName(rings(edges, new, hops).select("name")).distinct()
    scope = dirty.unionByName(rings(edges, dirty, hops).select("name")).distinct()
    fresh = residual_vectors(base.join(scope, "name", "left_semi"), edges, gamma, hops).join(dirty, "name", "left_semi")
    return old.join(dirty, "name", "left_anti").select("name", F.col("v").cast("array<double>").alias("v")).unionByName(fresh)
