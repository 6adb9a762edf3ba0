"""Queries of the problems for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read
from . import leakage, neighbours, packing, pairs, ranking, splitting, termfreq, topn, truncation

LIMIT, OVERLAP = 500, 50
TOP_CHUNKS = 6
SCORES = ["vector_score", "bm25_score", "score"]
FIRST_RESULTS = 5
CAPACITY = 2048
RUN, RUN_BY_LANG = 60, {"zh": 24}
TOKENS, TOKENS_BY_LANG = 40, {"zh": 16}  # template tokens, in the proportion of the runs


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every text chunk of more than 500 characters."""
    chunks = read(spark, d, "text_chunks")
    return splitting.split_oversized(chunks, "id", "text", LIMIT, OVERLAP, version="ingested_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be split."""
    return p1_pieces(spark, d).where("n_pieces > 1 and id is not null").select("id").distinct()


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of both tables with its defect."""
    cols = ["question", "answer"]
    asked = read(spark, d, "retrieval_records").select(
        F.lit("retrieval_records").alias("pair_table"), F.col("record_id").cast("string").alias("pair_id"), *cols
    )
    made = read(spark, d, "qa_pairs").select(F.lit("qa_pairs").alias("pair_table"), F.col("id").alias("pair_id"), *cols)
    return pairs.judged_pairs(asked.unionByName(made).where("pair_id is not null"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs."""
    return p2_pairs(spark, d).where("defect is not null").select("pair_table", "pair_id", "defect")


VECTORS = {"graph_nodes": "name", "text_chunks": "id", "keyword_entries": "entry_key"}


def _nearest(spark: SparkSession, d: str, least: float | None, recall: float) -> DataFrame:
    parts = [
        neighbours.most_similar(read(spark, d, t), k, "embedding", 5, 64, least, recall).withColumn("collection", F.lit(t))
        for t, k in VECTORS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every sound vector."""
    return _nearest(spark, d, None, 0.97).select("collection", "left", "right", F.round("similarity", 6).alias("similarity"), "place")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similarity 0.85 or more of which one is among the 5 nearest of the other."""
    near = _nearest(spark, d, 0.85, 0.998)
    pair = [F.least("left", "right").alias("left_id"), F.greatest("left", "right").alias("right_id")]
    return near.select("collection", *pair).distinct()


def p5_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 6 best chunks of every node."""
    entries = topn.scored_entries(read(spark, d, "node_mountings"), "node_id", "mounted_chunk_ids", "scores")
    best = topn.top_n(entries, TOP_CHUNKS)
    return best.select(F.col("g").alias("node_id"), F.col("item").alias("chunk_id"), "score", "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_topn(spark, d).select("node_id", "chunk_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One ranking of every query's results."""
    agg = ranking.aggregate_ranks(read(spark, d, "retrieval_results"), "query_id", "id", SCORES)
    out = ranking.full_ranking(agg)
    return out.select(F.col("g").alias("query_id"), F.col("item").alias("id"), F.round("rho", 9).alias("rho"), "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Results that every fair ranking has in the first five."""
    agg = ranking.aggregate_ranks(read(spark, d, "retrieval_results"), "query_id", "id", SCORES)
    found = ranking.certain_first(agg, FIRST_RESULTS, len(SCORES))
    return found.select(F.col("g").alias("query_id"), F.col("item").alias("id"))


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and chunks of every keyword, with its mark."""
    pairs = termfreq.term_pairs(read(spark, d, "keyword_entries"), "entry_key", "keyword", "chunk_ids")
    known = materialize(
        read(spark, d, "text_chunks").select(F.col("id").alias("record")).where("record is not null").distinct()
    )
    counts = termfreq.count_terms(pairs, known)
    return termfreq.mark_terms(counts, known.count()).withColumnRenamed("term", "keyword")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_terms(spark, d).where("mark is not null").select("keyword", "mark")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every piece of every document."""
    return packing.pack(packing.token_lengths(read(spark, d, "documents"), "doc_id", "text"), "doc_id", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split."""
    return p8_containers(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of held-out text in documents."""
    items = read(spark, d, "eval_items")
    return leakage.leaked_runs(
        read(spark, d, "documents"), "doc_id", "text", items, "item_id", ["question", "passage"], "lang", RUN, RUN_BY_LANG
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return p9_runs(spark, d).select("doc_id", "item_id").distinct()


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item, in whole or in part, with other numbers, names or units."""
    return leakage.template_runs(
        read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", ["question", "passage"],
        "lang", TOKENS, TOKENS_BY_LANG,
    )


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """How every document breaks off, if it does."""
    return truncation.truncated(read(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut off."""
    return p10_documents(spark, d).where("reason is not null").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents by source."""
    return truncation.share_by_source(p10_documents(spark, d), "source")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_pairs, p3_found, p3_neighbours, p5_found, p5_topn, p6_found, p6_ranking,
        p7_found, p7_terms, p8_found, p8_containers, p9_found, p9_runs, p9_templates,
        p10_found, p10_documents, p10_sources,
    )
}

from .sql import SQL  # noqa: E402,F401
