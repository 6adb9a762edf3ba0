"""The build: texts to chunks, vectors, graph, keywords and mounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.splitters import chunks_of_files
from ..functions.vectors import cosine
from ..operators import caches, fusion, graph, lexical, mount, node_embed, parsing
from ..providers import EmbeddingProvider, embed_column, map_column
from ..session import materialize
from .config import BuildConfig
from .retrieval import Store


def build_graph(files: DataFrame, generate: Callable[[str], str], chinese_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges over all files, and the outcome of each file.

    generate turns a text into model output with diagrams; its errors become
    rows.  Names shared by files are merged, the first file (by name) winning.
    """
    told = materialize(map_column(files, "tg_id", "text", generate))
    codes = materialize(parsing.extract_diagrams(told.where("success"), "tg_id", "output"))
    nodes, edges = parsing.graph_rows(codes, "tg_id", "flowchart", "sequence", chinese_only)
    order = F.struct(F.col("source_tg")[0].alias("tg"), "ord")
    merged = graph.merge_nodes(nodes.withColumn("o", order), "o")
    first = graph.first_per(edges, ["src", "dst"], [F.col("source_tg"), F.col("ord")])
    return merged, first, told.select(F.col("tg_id").alias("item"), "success", "error_message")


def build_keywords(chunks: DataFrame, chunk_vec: DataFrame, embedder: EmbeddingProvider, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, keyword, weight, pos) and (keyword, v): distinct words
    of two or more characters of each chunk, chosen by MMR against its vector."""
    words = F.array_distinct(F.filter(lexical.tokens(F.col("text")), lambda t: F.length(t) >= 2))
    cand = chunks.where("text is not null").select(F.col("id"), F.posexplode(words).alias("ord", "word"))
    once = cand.select(F.col("word").alias("keyword"), "word").distinct()
    kw_vec = materialize(embed_column(once, "keyword", "word", embedder))
    rows = cand.join(kw_vec.withColumnRenamed("keyword", "word"), "word").join(chunk_vec.withColumnRenamed("v", "c"), "id")
    rows = rows.select("id", "word", "ord", F.round(cosine(F.col("v"), F.col("c")), 9).alias("relevance"), "v")
    chosen = lexical.mmr(rows, config.keywords_per_chunk, config.diversity)
    weighted = chosen.select(
        F.col("id").alias("chunk_id"), F.col("word").alias("keyword"),
        lexical.keyword_position_weight(F.col("pos")).alias("weight"), "pos",
    )
    return weighted, kw_vec.join(weighted.select("keyword").distinct(), "keyword", "left_semi")


def build(
    files: DataFrame,
    embedder: EmbeddingProvider,
    generate: Callable[[str], str],
    config: BuildConfig | None = None,
    log: DataFrame | None = None,
    into: Store | None = None,
) -> tuple[Store, DataFrame]:
    """B1: everything from whole-file rows (file_path, source_file, tg_id, text).

    Files with a successful row in log are left out (J11).  With into the new
    files are merged into that store: what it knows of a name, an edge or a
    keyword stays, chunks of files that are built again are replaced, and only
    vectors and mounts that the change can touch are computed again.  Returns the
    store and the outcome of each file.
    """
    config = config or BuildConfig()
    if log is not None:
        files = caches.files_to_process(files, log)
    nodes, edges, outcome = build_graph(files, generate)
    chunks = materialize(chunks_of_files(files, config.splitter))
    chunk_vec = materialize(embed_column(chunks, "id", "text", embedder))
    chunk_kw, kw_vec = build_keywords(chunks, chunk_vec, embedder, config)
    if into is not None:
        nodes, edges = merge_graphs(into, nodes, edges)
    nodes, edges = materialize(nodes), materialize(edges)
    if into is not None:
        stale = into.chunks.join(files.select("source_file").distinct(), "source_file", "left_semi").select("id").distinct()
        chunks, chunk_vec = (
            materialize(old.join(stale, "id", "left_anti").unionByName(new, allowMissingColumns=True))
            for old, new in ((into.chunks, chunks), (into.chunk_vec, chunk_vec))
        )
        kept = into.chunk_kw.join(stale.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti")
        chunk_kw = kept.unionByName(chunk_kw, allowMissingColumns=True)
        kw_vec = fusion.first_wins([into.kw_vec, kw_vec], ["keyword"]).join(chunk_kw.select("keyword").distinct(), "keyword", "left_semi")
    node_vec = materialize(node_vectors(nodes, edges, embedder, config, into))
    located = nodes.select("name", F.explode("source_tg").alias("tg")).join(node_vec, "name")
    own = chunks.select(F.col("id").alias("chunk_id"), F.col("tg_id").alias("tg")).join(chunk_vec.withColumnRenamed("id", "chunk_id"), "chunk_id")
    if into is not None:  # nodes of the new files, and nodes that lost a chunk, are mounted again
        touched = nodes.select("name", F.explode("source_tg").alias("tg")).join(files.select(F.col("tg_id").alias("tg")).distinct(), "tg", "left_semi")
        touched = touched.select("name").unionByName(into.mounts.join(stale.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi").select("name"))
        touched = materialize(touched.distinct())
        located = located.join(touched, "name", "left_semi")
    mounts = mount.similarity_top_k(located, own, config.mounts_per_node, embedder.dimension)
    if into is not None:
        mounts = into.mounts.join(touched, "name", "left_anti").unionByName(mounts, allowMissingColumns=True)
    store = Store(nodes, edges, node_vec, chunks, chunk_vec, materialize(mounts), materialize(chunk_kw), materialize(kw_vec))
    return store, outcome


def merge_graphs(into: Store, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a store and of new files: the store's type, properties
    and edges win, sources are joined with the store's first."""
    both = into.nodes.withColumn("o", F.lit(0)).unionByName(nodes.withColumn("o", F.lit(1)), allowMissingColumns=True)
    return graph.merge_nodes(both, "o"), fusion.first_wins([into.edges, edges], ["src", "dst"])


def node_vectors(nodes: DataFrame, edges: DataFrame, embedder: EmbeddingProvider, config: BuildConfig, into: Store | None) -> DataFrame:
    """Vectors of all nodes; after an update those of new nodes and, with the
    residual method, of what lies within hops of them."""
    base = materialize(embed_column(nodes.withColumn("t", F.col("name")), "name", "t", embedder))
    kw = {"gamma": config.gamma, "hops": config.hops} if config.method == "residual" else {}
    if config.method == "residual" and into is not None:
        return node_embed.embed_new_nodes(into.node_vec, base, edges, **kw)
    if config.method == "weighted":
        context = node_embed.context_text(nodes, edges).where("context <> ''")
        return node_embed.embed_nodes(base, edges, "weighted", embed_column(context, "name", "context", embedder))
    return node_embed.embed_nodes(base, edges, config.method, **kw)
