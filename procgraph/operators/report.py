"""Small projections and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extractor_statistics(chunk_kw: DataFrame, n_texts: int) -> DataFrame:
    """A10: texts, keywords and keywords per text (0 for no text)."""
    per = F.col("n_keywords") / F.lit(n_texts) if n_texts else F.lit(0.0)
    return chunk_kw.agg(F.count("*").alias("n_keywords")).select(
        F.lit(n_texts).alias("n_texts"), "n_keywords", F.round(per, 6).alias("keywords_per_text")
    )


def step_order(paths: DataFrame) -> DataFrame:
    """(query_id, steps): the distinct steps of a query's paths (query_id,
    anchor, path) in the order of their first appearance, joined by arrows."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("anchor", "path"))), lambda p: p["path"])
    return paths.groupBy("query_id").agg(F.array_join(F.array_distinct(F.flatten(listed)), " → ").alias("steps"))


def numbered_context(results: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, context): the first results as numbered, tagged lines."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), "source_type", F.lit(") "), F.coalesce("text", F.lit("")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = results.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"])
    return top.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))


def by_hop(reached: DataFrame) -> DataFrame:
    """K8: reached nodes with their place by hop, then name, within each start."""
    w = Window.partitionBy("start").orderBy("hop", "name")
    return reached.withColumn("place", F.row_number().over(w))


def without_vectors(rows: DataFrame, *vectors: str) -> DataFrame:
    """Rows for output, vector columns dropped."""
    return rows.drop(*(vectors or ("embedding", "v")))


def checked_namespace(name: str) -> str:
    """Letters, digits, underscores and ideographs only."""
    if not re.fullmatch(r"[a-zA-Z0-9_一-鿿]+", name):
        raise ValueError(f"not a valid namespace: {name!r}")
    return name


def replace_table(rows: DataFrame, path: str) -> None:
    """The stored table replaced by rows."""
    rows.write.mode("overwrite").parquet(path)


def clear_table(rows: DataFrame, path: str) -> None:
    """V9: an empty table of the same schema in its place."""
    replace_table(rows.limit(0), path)
