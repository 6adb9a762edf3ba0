"""Graph operators over nodes and edges tables.

Adjacency is never stored: it is a join on the edges' src or dst.  Traversals
start from all rows of a frontier at once, so one plan serves a whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; a window of rank 1, cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edges_of_nodes(nodes: DataFrame) -> DataFrame:
    """(src, dst, ord) of nodes with successor lists; repeated edges count once,
    ord being the first position."""
    exploded = nodes.where("name is not null").select(
        F.col("name").alias("src"), F.posexplode("successors").alias("ord", "dst")
    )
    return exploded.where("dst is not null").groupBy("src", "dst").agg(F.min("ord").cast("long").alias("ord"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge (by ord) of every (src, dst); dangling edges stay."""
    return first_per(edges, ["src", "dst"], [F.col("ord")])


def last_edge(edges: DataFrame) -> DataFrame:
    """The last edge of every (src, dst), as the edge lookup returns it."""
    return first_per(edges, ["src", "dst"], [F.desc("ord")])


def upsert_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The last row of every name within a document."""
    return first_per(nodes, ["name"], [F.desc(order)])


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The first row of every name, with the ordered union of source_tg.

    Partial aggregates only: a name's documents are collected once each.
    """
    exploded = nodes.select("name", F.col(order).alias("o"), F.posexplode_outer("source_tg").alias("p", "tg"))
    first = exploded.where("tg is not null").groupBy("name", "tg").agg(F.min(F.struct("o", "p")).alias("at"))
    sources = first.groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "tg"))), lambda s: s["tg"]).alias("source_tg")
    )
    kept = nodes.groupBy("name").agg(F.min_by(F.struct("node_type", "properties"), order).alias("n"))
    return kept.join(sources, "name", "left").select(
        "name", "n.node_type", "n.properties", F.coalesce("source_tg", F.array().cast("array<string>")).alias("source_tg")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """(name, successors, predecessors) in the order of the edges."""
    def side(key: str, other: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("ord", other)))
        return edges.groupBy(F.col(key).alias("name")).agg(F.transform(pairs, lambda s: s[other]).alias(name))

    return side("src", "dst", "successors").join(side("dst", "src", "predecessors"), "name", "full_outer")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, ord): edges read forward, backward or both ways."""
    forward = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "ord")
    backward = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "ord")
    if direction == "forward":
        return forward
    if direction == "backward":
        return backward
    if direction != "both":
        raise ValueError("direction must be forward, backward or both")
    return forward.unionByName(backward).groupBy("a", "b").agg(F.min("ord").alias("ord"))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """G1, U4: distinct (name, neighbour)."""
    return directed(edges, direction).select(F.col("a").alias("name"), F.col("b").alias("neighbour")).distinct()


def adjacent_edges(edges: DataFrame, nodes: DataFrame, direction: str = "forward") -> DataFrame:
    """Neighbours that are nodes, with the attributes of the edge; without
    an edge type the relation is plain succession."""
    step = directed(edges, direction)
    flipped = direction == "backward"
    attrs = last_edge(edges).select(
        F.col("dst" if flipped else "src").alias("a"),
        F.col("src" if flipped else "dst").alias("b"),
        *[F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("edge_type", "relation_name")],
        F.try_element_at("properties", F.lit("condition")).alias("condition")
        if "properties" in edges.columns
        else F.lit(None).cast("string").alias("condition"),
    )
    return (
        step.join(nodes.select(F.col("name").alias("b")).distinct(), "b", "left_semi")
        .join(attrs, ["a", "b"], "left")
        .select(
            F.col("a").alias("name"),
            F.col("b").alias("neighbour"),
            F.coalesce("edge_type", F.lit("next")).alias("edge_type"),
            F.coalesce("relation_name", F.lit("")).alias("relation_name"),
            F.coalesce("condition", F.lit("")).alias("condition"),
        )
    )


def resolve_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ids replaced by names; an edge with an unknown end is dropped."""
    a = ids.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = ids.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), *rest)


def rings(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both", cut: int = 3) -> DataFrame:
    """(start, name, hop) of everything within hops of each start, with
    its smallest hop; starts has one column, name, and is itself left out.

    Each level joins only the frontier and drops what was seen.  Every cut levels
    the lineage is cut by a checkpoint.  A node that is not in the nodes table
    is recorded but has no edges to go on with.
    """
    step = directed(edges, direction).select("a", "b").distinct()
    frontier = starts.select(F.col("name").alias("start"), "name").distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = (
            frontier.join(step, frontier["name"] == step["a"])
            .select("start", F.col("b").alias("name"))
            .distinct()
            .join(seen, ["start", "name"], "left_anti")
        )
        if hop % cut == 0 and hop < hops:
            reached = materialize(reached)
        seen = seen.unionByName(reached.withColumn("hop", F.lit(hop)))
        frontier = reached
    return seen.where("hop > 0")


def longest_paths(edges: DataFrame, starts: DataFrame, direction: str = "forward", max_edges: int = 5) -> DataFrame:
    """(name, path) with the longest simple path of at most max_edges edges;
    of equally long ones the first in the order of the edges.

    Paths grow by one join per edge.  A path ends where no edge leads to an
    unvisited node, and only ends of the greatest length count, so shorter ones
    are reduced to one per start as they end.
    """
    step = directed(edges, direction)
    live = starts.select("name").distinct().select(
        "name", F.array("name").alias("path"), F.array().cast("array<bigint>").alias("ords")
    )
    best = live
    for _ in range(max_edges):
        live = (
            live.withColumn("a", F.element_at("path", -1))
            .join(step, "a")
            .where(~F.array_contains("path", F.col("b")))
            .select("name", F.array_append("path", F.col("b")).alias("path"), F.array_append("ords", F.col("ord")).alias("ords"))
        )
        level = live.groupBy("name").agg(F.min(F.struct("ords", "path")).alias("m")).select("name", "m.path", "m.ords")
        best = best.unionByName(level)
    ranked = best.groupBy("name").agg(F.max_by("path", F.size("path")).alias("path"))
    return ranked


def expand_results(results: DataFrame, edges: DataFrame, target: int, decay: float = 0.7, always: bool = False) -> DataFrame:
    """Results (query_id, id, score) with unseen direct neighbours at score *
    decay, best first, until target rows per query (Q-01: a query that already
    has target rows gets none, unless always)."""
    sizes = results.groupBy("query_id").agg(F.count("*").alias("n"))
    near = neighbours(edges).select(F.col("name").alias("id"), "neighbour")
    fresh = (
        results.join(near, "id")
        .groupBy("query_id", F.col("neighbour").alias("id"))
        .agg((F.max("score") * decay).alias("score"))
        .join(results, ["query_id", "id"], "left_anti")
        .join(sizes, "query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    room = F.lit(target) if always else F.lit(target) - F.col("n")
    added = fresh.withColumn("k", F.row_number().over(order)).where(F.col("k") <= room)
    both = results.select("query_id", "id", "score", F.lit(0).alias("hop")).unionByName(
        added.select("query_id", "id", "score", F.lit(1).alias("hop"))
    )
    return both.withColumn("rank", F.row_number().over(order))


def causal_context(results: DataFrame, forward: DataFrame, backward: DataFrame, compat: bool = False) -> DataFrame:
    """Results (id, text, ...) with the chains of causes and effects added to
    the text, and their lengths.  The node itself is left out of its causes, which
    come in causal order; with compat the farthest cause is dropped instead and
    the order kept (Q-02)."""
    f = forward.select(F.col("name").alias("id"), F.col("path").alias("effects"))
    b = backward.select(F.col("name").alias("id"), F.col("path").alias("causes"))
    least = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    before = F.slice("causes", 1, least("causes")) if compat else F.reverse(F.slice("causes", 2, least("causes")))
    after = F.slice("effects", 2, least("effects"))
    return (
        results.join(b, "id", "left")
        .join(f, "id", "left")
        .withColumns({"_b": F.array_join(before, " → "), "_a": F.array_join(after, " → ")})
        .withColumn(
            "text",
            F.concat_ws(
                " | ",
                "text",
                F.when(F.col("_b") != "", F.concat(F.lit("原因链: "), F.col("_b"))),
                F.when(F.col("_a") != "", F.concat(F.lit("后果链: "), F.col("_a"))),
            ),
        )
        .withColumn("backward_length", F.coalesce(F.size("causes"), F.lit(1)))
        .withColumn("forward_length", F.coalesce(F.size("effects"), F.lit(1)))
        .drop("causes", "effects", "_b", "_a")
    )


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: rows (measure, value): nodes, edges, nodes by type, nodes with a vector."""
    by_type = nodes.groupBy(F.concat(F.lit("type:"), F.coalesce("node_type", F.lit("?"))).alias("measure")).agg(
        F.count("*").alias("value")
    )
    totals = nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("measure"), "value")
    links = edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("measure"), "value")
    out = by_type.unionByName(totals).unionByName(links)
    if "embedding" in nodes.columns:
        held = nodes.agg(F.count(F.when(F.size("embedding") > 0, 1)).alias("value"))
        out = out.unionByName(held.select(F.lit("with_vector").alias("measure"), "value"))
    return out
