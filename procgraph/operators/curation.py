"""Curation of documents and question sets."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_and_procedure, strip
from ..session import filled, materialize
from .graph import first_per

#: Titles of a product that one round decides in order, and kept titles that may be broadcast.
ROUND_TITLES, MAX_KEPT = 2000, 200_000
#: Parts of a product when kept titles are shuffled instead.
PARTS = 64
#: Buckets of letters and of pairs of letters in a profile.
LETTERS, PAIRS = 64, 192


def titled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, product, procedure, title, length)."""
    product, procedure = product_and_procedure(F.col(text))
    title = strip(F.regexp_replace(F.substring_index(F.col(text), "\n", 1), r"^#+\s*", ""))
    return docs.where(F.col(text).isNotNull()).select(
        F.col(f"`{key}`").alias("key"), product.alias("product"), procedure.alias("procedure"), title.alias("title"),
        F.length(text).alias("length"),
    )


def exact_title_dedup(rows: DataFrame) -> DataFrame:
    """B13, first step: the longest row of every (product, title); ties by key."""
    return first_per(rows, ["product", "title"], [F.desc("length"), F.col("key")])


def similar(a: str, b: str, threshold: float) -> bool:
    """ratio above threshold; the cheap upper bounds are tried first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > threshold and m.quick_ratio() > threshold and m.ratio() > threshold


def profiles(texts: list[str]) -> np.ndarray:
    """Counts of hashed letters and of hashed pairs of letters of each text."""
    out = np.zeros((len(texts), LETTERS + PAIRS), np.uint16)
    for row, t in zip(out, texts):
        c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
        row[:LETTERS] = np.bincount(c % LETTERS, minlength=LETTERS)
        if len(c) > 1:
            row[LETTERS:] = np.bincount((c[:-1] * np.uint32(31) + c[1:]) % PAIRS, minlength=PAIRS)
    return out


class Kept:
    """Titles kept so far; alike tells whether one of them is more than threshold
    similar to a text.

    A ratio above t needs matching letters M > t (la + lb) / 2.  The letters that
    both hold are no fewer.  M letters in at most (la - M) + (lb - M) + 1 blocks
    hold at least M less the blocks in pairs of neighbours, which both hold too.
    Counting in buckets can only raise what both hold, so no pair above the
    threshold is passed over; the others are compared letter by letter.
    """

    def __init__(self, threshold: float):
        self.threshold, self.texts, self.n = threshold, [], 0
        self.table, self.size = np.zeros((64, LETTERS + PAIRS), np.uint16), np.zeros(64, np.int64)

    def add(self, text: str, profile: np.ndarray) -> None:
        if self.n == len(self.size):
            self.table, self.size = np.concatenate([self.table] * 2), np.concatenate([self.size] * 2)
        self.table[self.n], self.size[self.n] = profile, len(text)
        self.texts.append(text)
        self.n += 1

    def alike(self, text: str, profile: np.ndarray) -> bool:
        both = self.size[: self.n] + len(text)
        least = self.threshold * both / 2
        near = np.flatnonzero(np.minimum(self.size[: self.n], len(text)) >= least - 1e-9)
        if not len(near):
            return False
        shared = np.minimum(self.table[near], profile)
        both, least = both[near], least[near]
        good = shared[:, :LETTERS].sum(1) >= least - 1e-9
        good &= shared[:, LETTERS:].sum(1) >= least - (both - 2 * least) - 1 - 1e-9
        return any(similar(text, self.texts[i], self.threshold) for i in near[good].tolist())


def fuzzy_dedup(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """B13, second step: (key, product, procedure, length) kept by the greedy rule:
    longest first, a row goes if its procedure is more than threshold similar to
    one kept before it in its product.

    The rule depends on order, so it runs in rounds: the next ROUND_TITLES rows of
    every product are decided in order, then all later rows are filtered against
    what was kept, in parallel.  Each round decides what the sequential rule
    would; no product is gathered in one task.  Equal procedures are decided once.
    """
    order = [F.desc("length"), F.col("key")]
    w = Window.partitionBy("product").orderBy(*order)
    columns = ["key", "product", "procedure", "length"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    # Of equal procedures only the first can be kept (its ratio to the others is 1).
    left = materialize(first_per(rows.select(*columns), ["product", "procedure"], order))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True])
        kept, keep = Kept(threshold), []
        for p, profile in zip(pdf["procedure"], profiles(pdf["procedure"].tolist())):
            keep.append(not kept.alike(p, profile))
            if keep[-1]:
                kept.add(p, profile)
        return pdf[keep]

    def unlike(texts: list[str], known: list[str]) -> list[bool]:
        kept = Kept(threshold)
        for p, profile in zip(known, profiles(known)):
            kept.add(p, profile)
        return [not kept.alike(p, profile) for p, profile in zip(texts, profiles(texts))]

    decided = None
    while not left.isEmpty():
        head = left.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ROUND_TITLES).drop("n")
        fresh = materialize(head.groupBy("product").applyInPandas(decide, schema))
        decided = fresh if decided is None else decided.unionByName(fresh)
        rest = left.join(head.select("key", "product"), ["key", "product"], "left_anti").select(*columns)
        left = materialize(_filtered(rest, fresh, unlike, schema))
    return decided if decided is not None else left


def _filtered(rest: DataFrame, fresh: DataFrame, unlike, schema: str) -> DataFrame:
    """The rows of rest that are like no fresh title of their product: against a
    broadcast of a checked size, else by parts of a product, each with a copy of
    the product's fresh titles."""
    known = fresh.select("product", "procedure")
    listed = known.limit(MAX_KEPT + 1).collect()
    if len(listed) <= MAX_KEPT:
        by_product: dict[str, list[str]] = {}
        for r in listed:
            by_product.setdefault(r.product, []).append(r.procedure)
        held = rest.sparkSession.sparkContext.broadcast(by_product)

        def scan(batches):
            for pdf in batches:
                for g, some in pdf.groupby("product", dropna=False):
                    yield some[unlike(some["procedure"].tolist(), held.value.get(None if pd.isna(g) else g, []))]

        return rest.mapInPandas(filled(scan), schema)
    salted = rest.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def pair(some: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
        some = some.drop(columns="part")
        return some[unlike(some["procedure"].tolist(), titles["procedure"].tolist())] if len(some) else some

    by = ["product", "part"]
    return salted.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(pair, schema)


def dedup_flags(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every row with kept = true or false instead of deleted files."""
    kept = fuzzy_dedup(exact_title_dedup(rows), threshold)
    return rows.join(kept.select("key", F.lit(True).alias("kept")), "key", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def renumber(rows: DataFrame, order: str, prefix: str = "BATCH-", start: int = 1) -> DataFrame:
    """Rows with new_name prefix0001, prefix0002, ... in the order of a
    unique column; a mapping, nothing is renamed in place.

    Positions come from a range partitioning: local position plus the rows of
    earlier partitions, so no task sees all rows.
    """
    ranged = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r.part: r.size for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}
    offsets, so_far = [], start
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(so_far)]
        so_far += sizes[p]
    if not offsets:
        return ranged.drop("_at").withColumns({"number": F.lit(0).cast("long"), "new_name": F.lit("")})
    at = F.create_map(*offsets)[part].cast("long") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("number", at).withColumn("new_name", F.format_string(prefix + "%04d", "number")).drop("_at")


def first_questions(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The first pair of every stripped question; blank questions are dropped."""
    rows = pairs.withColumn("question", strip(F.col("question"))).where("question <> ''")
    return first_per(rows, ["question"], [F.col(c) for c in order])


def qa_statistics(pairs: DataFrame) -> DataFrame:
    """Pairs by type and difficulty; missing ones are 'unknown'."""
    return (
        pairs.select(
            F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
            F.coalesce(F.lower(strip(F.col("difficulty"))), F.lit("unknown")).alias("difficulty"),
        )
        .groupBy("question_type", "difficulty")
        .agg(F.count("*").alias("n"))
    )


QA_ITEM = (
    "id string, question string, answer string, question_type string, difficulty string, relevant_nodes array<string>, "
    "reasoning_path array<string>, source_chunks array<string>, expected_hops int, requires_graph_reasoning boolean, "
    "requires_causal_reasoning boolean, keywords array<string>, source_keywords array<string>, source_evidence array<string>"
)


def batch_schema() -> str:
    """Schema of a batch file."""
    fields = ",".join(":".join(f.split()) for f in QA_ITEM.split(", "))
    return f"id string, title string, qa_pairs array<struct<{fields}>>"


def flatten_batches(batches: DataFrame) -> DataFrame:
    """One row per question of (id, title, qa_pairs), with defaults and the
    alternative names of fields."""
    none = F.array().cast("array<string>")
    q = F.col("q")
    return (
        batches.select(F.col("id").alias("source_batch"), F.coalesce("title", F.lit("")).alias("source_title"), F.posexplode("qa_pairs").alias("pos", "q"))
        .select(
            "source_batch", "source_title", "pos", F.coalesce(q["id"], F.lit("")).alias("id"),
            strip(q["question"]).alias("question"), F.coalesce(q["answer"], F.lit("")).alias("answer"),
            F.coalesce(q["question_type"], F.lit("unknown")).alias("question_type"),
            F.coalesce(q["difficulty"], F.lit("unknown")).alias("difficulty"),
            F.coalesce(q["expected_hops"], F.lit(0)).alias("expected_hops"),
            F.coalesce(q["requires_graph_reasoning"], q["requires_causal_reasoning"], F.lit(False)).alias("requires_graph_reasoning"),
            F.when(F.size(q["keywords"]) > 0, q["keywords"]).otherwise(F.coalesce(q["source_keywords"], none)).alias("keywords"),
            F.coalesce(q["relevant_nodes"], none).alias("relevant_nodes"),
            F.coalesce(q["source_evidence"], none).alias("source_evidence"),
        )
        .where("question <> ''")
    )
