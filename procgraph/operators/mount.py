"""Mounting text chunks on graph nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut
from ..functions.vectors import cosine

#: Nodes or chunks of one source that are compared in one task.
SIDE_BLOCK = 2_000


def source_matches(chunk_source: str, tg: str, prefix: bool = False):
    """Same source; with prefix the reference's looser rule (Q-14)."""
    same = F.col(chunk_source) == F.col(tg)
    return same | F.col(chunk_source).startswith(F.concat(F.col(tg), F.lit("_"))) if prefix else same


def similarity_top_k(nodes: DataFrame, chunks: DataFrame, k: int, dim: int, digits: int = 6) -> DataFrame:
    """(name, chunk_id, score, rank): for each (name, tg) of nodes (name,
    tg, v) the k most similar chunks (chunk_id, tg, v) of that source.

    Both sides are cut in blocks by a hash inside their source, and blocks meet
    on (source, node block, chunk block); a source with a third of all rows is
    spread over many tasks, each of which sends k rows per node on.  A node in
    several sources takes its k best over all.
    """
    def blocks(rows: DataFrame, key: str) -> DataFrame:
        n = rows.groupBy("tg").agg(F.ceil(F.count("*") / SIDE_BLOCK).cast("int").alias("n"))
        return rows.join(n, "tg").withColumn("b", F.pmod(F.xxhash64(key), F.col("n")).cast("int"))

    a, b = blocks(nodes, "name"), blocks(chunks, "chunk_id")
    sizes_a = a.select("tg", F.col("n").alias("na")).distinct()
    sizes_b = b.select("tg", F.col("n").alias("nb")).distinct()
    left = a.join(sizes_b, "tg").select(
        "tg", F.col("name").alias("key"), "v", F.col("b").alias("ba"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"), F.lit(0).alias("side"),
    )
    right = b.join(sizes_a, "tg").select(
        "tg", F.col("chunk_id").alias("key"), "v", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ba"),
        F.col("b").alias("bb"), F.lit(1).alias("side"),
    )

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        keys = np.array(table.column("key").to_pylist(), object)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return pa.table({"name": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        y = y[np.argsort(keys[y], kind="stable")]
        s = np.round(v[x] @ v[y].T, digits)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(s, order, 1)
        return pa.table(
            {
                "name": pa.array(np.repeat(keys[x], order.shape[1]), pa.string()),
                "chunk_id": pa.array(keys[y][order.ravel()], pa.string()),
                "score": best.ravel(),
            }
        )

    pairs = left.unionByName(right).groupBy("tg", "ba", "bb").applyInArrow(compare, "name string, chunk_id string, score double")
    once = pairs.groupBy("name", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sound(rows: DataFrame, key: str, dim: int, *more: str) -> DataFrame:
    """(key, more, v) of rows with a usable vector, one per key."""
    v = F.col("embedding")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    one = rows.where(F.col(key).isNotNull() & good).groupBy(key)
    picked = one.agg(F.max(F.struct(*[F.col(m) for m in more], v.alias("v"))).alias("r"))
    return picked.select(key, *[F.col(f"r.{m}").alias(m) for m in more], "r.v")


def new_mounts(mounts: DataFrame, existing: DataFrame) -> DataFrame:
    """Mounts of nodes that have none yet."""
    return mounts.join(existing.select("name").distinct(), "name", "left_anti")


def mount_statistics(nodes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Nodes in all, nodes with chunks, mounts."""
    n = nodes.select("name").distinct().agg(F.count("*").alias("n_nodes"))
    m = mounts.agg(F.countDistinct("name").alias("n_mounted"), F.count("*").alias("n_mounts"))
    return n.select("n_nodes", F.lit(1).alias("one")).join(m.select("*", F.lit(1).alias("one")), "one").drop("one")


def enrichment_text(mounts: DataFrame, chunks: DataFrame, size: int = 300, query: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(name, text): mounted texts cut at size and joined, in mounting order
    or, with query (one row, q), by similarity to it; only the first k."""
    rows = mounts.select("name", F.col("chunk_id").alias("id"), "rank").join(chunks.select("id", "text", *(["v"] if query is not None else [])), "id")
    if query is not None:
        q = query.first()["q"]
        rows = rows.withColumn("o", -F.round(cosine(F.lit([float(x) for x in q]), F.col("v")), 6))
    else:
        rows = rows.withColumn("o", F.col("rank").cast("double"))
    w = Window.partitionBy("name").orderBy("o", "rank", "id")
    rows = rows.withColumn("n", F.row_number().over(w))
    rows = rows.where(F.col("n") <= k) if k is not None else rows
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", cut(F.col("text"), size).alias("t")))), lambda s: s["t"])
    return rows.groupBy("name").agg(F.array_join(listed, " | ").alias("text"))


def node_context(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, context): the node and, on a second line, its mounted text."""
    j = nodes.select("name").distinct().join(texts, "name", "left")
    known = F.when(F.col("text") != "", F.concat(F.lit("【相关知识】"), F.col("text")))
    return j.select("name", F.concat_ws("\n", F.concat(F.lit("【事件】"), F.col("name")), known).alias("context"))
