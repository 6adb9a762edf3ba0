"""Logs of builds and questions, token usage, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_class, needs_retry, question_hash, strip
from .graph import first_per

#: Cost of a million tokens by category.
RATES = {"prompt": 0.8, "completion": 2.0, "embedding": 0.5}


def build_statistics(log: DataFrame) -> DataFrame:
    """A3: files by success, nodes and edges of the successful ones."""
    ok = F.coalesce("success", F.lit(False))
    return log.agg(
        F.count("*").alias("n_files"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("nodes_count"))), F.lit(0)).alias("n_nodes"),
        F.coalesce(F.sum(F.when(ok, F.col("edges_count"))), F.lit(0)).alias("n_edges"),
    )


def question_statistics(log: DataFrame) -> DataFrame:
    """A4: totals over all rows, the average of tokens over successful ones."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return log.agg(
        F.count("*").alias("n_questions"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.coalesce(F.sum("token_usage"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("token_usage"))), F.lit(0.0)), 6).alias("avg_tokens"),
    )


def failures(log: DataFrame) -> DataFrame:
    """A5: failed rows by class of error."""
    kind = error_class(F.col("status"), F.col("answer"), F.col("error"))
    return log.select(kind.alias("error_class")).where("error_class is not null").groupBy("error_class").agg(F.count("*").alias("n"))


def failed_questions(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """Questions of failed rows whose error holds pattern."""
    bad = log.where(F.coalesce(F.col("status"), F.lit("")) != "success")
    return (bad.where(F.contains(F.coalesce("error", F.lit("")), F.lit(pattern))) if pattern else bad).select("question", "error")


def questions_to_process(asked: DataFrame, log: DataFrame, retry: bool = True) -> DataFrame:
    """Asked questions not in the log; with retry those whose latest answer
    failed come again.  Repeated questions in asked stay."""
    done = latest_answers(log)
    if retry:
        done = done.where(~needs_retry(F.col("status"), F.col("answer")))
    keyed = asked.withColumn("question_hash", question_hash(F.col("question")))
    return keyed.join(done.select("question_hash").distinct(), "question_hash", "left_anti")


def latest_answers(log: DataFrame) -> DataFrame:
    """The latest row of every question hash."""
    keyed = log.where("question is not null").withColumn("question_hash", question_hash(F.col("question")))
    return first_per(keyed, ["question_hash"], [F.desc_nulls_last("retrieval_time"), F.desc_nulls_last("record_id")])


def files_to_process(files: DataFrame, log: DataFrame, key: str = "source_file") -> DataFrame:
    """Files without a successful row of their name."""
    return files.join(log.where("success").select(key).distinct(), key, "left_anti")


def all_done(items: DataFrame, done: DataFrame, key: str) -> bool:
    """Nothing is left to do (no rows are collected)."""
    return items.join(done.select(key).distinct(), key, "left_anti").isEmpty()


def upsert_flags(flags: DataFrame, new: DataFrame) -> DataFrame:
    """Stage flags (stage, done, updated_at), new ones replacing old."""
    return first_per(new.withColumn("_p", F.lit(0)).unionByName(flags.withColumn("_p", F.lit(1))), ["stage"], [F.col("_p")]).drop("_p")


def token_totals(usage: DataFrame, run: str | None = None) -> DataFrame:
    """Tokens by category, in all and in one run."""
    mine = F.when(F.col("run_id") == F.lit(run), F.col("tokens")) if run is not None else F.col("tokens")
    return usage.groupBy("category").agg(F.sum("tokens").alias("total"), F.coalesce(F.sum(mine), F.lit(0)).alias("current"))


def token_cost(usage: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Tokens and cost by category; unknown categories cost nothing."""
    rate = F.create_map(*[F.lit(x) for kv in (rates or RATES).items() for x in kv])
    return (
        usage.groupBy("category")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("cost", F.round(F.col("tokens") / 1e6 * F.coalesce(F.try_element_at(rate, F.col("category")), F.lit(0.0)), 9))
    )


def fingerprint(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n_items, digest): sha256 over the sorted digests of the
    distinct items.  Items are digested where they lie, so a group's list holds
    one hash per item; two levels keep a large group out of one task."""
    one = rows.where(F.col(item).isNotNull()).select(group, F.sha2(F.col(item), 256).alias("h")).distinct()
    parts = one.groupBy(group, F.substring("h", 1, 2).alias("b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n")
    )
    return parts.groupBy(group).agg(
        F.sum("n").alias("n_items"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256).alias("digest"),
    )


def distinct_questions(log: DataFrame) -> DataFrame:
    """(question_hash, question) of stripped questions, each once."""
    keyed = log.where("question is not null").select(question_hash(F.col("question")).alias("question_hash"), strip(F.col("question")).alias("question"))
    return keyed.groupBy("question_hash").agg(F.min("question").alias("question"))
