"""Frequency of every distinct term (problem 7).

Method: range-partitioned external sort of (term, record) pairs and run-length
scanning.  Equal pairs meet in one partition, so the runs of a term that spans
several partitions add up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import filled, materialize


def fold(term: str | None) -> str | None:
    """NFKC, trimmed, runs of white space as one space, lower case; None if blank."""
    if term is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", term).split()).lower() or None


def term_pairs(entries: DataFrame, key: str, term: str, records: str) -> DataFrame:
    """(term, record, times): how often each folded term names each record.

    Repeated rows of one key count once; a term that names no record keeps one
    row with a null record and times 0.  Pairs are summed inside each batch
    before they are shuffled.
    """
    rows = entries.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{term}`").alias("term"), F.col(f"`{records}`").alias("records")
    )
    keyed = rows.where("k is not null").dropDuplicates(["k"]).unionByName(rows.where("k is null"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = {t: fold(t) for t in pdf["term"].dropna().unique()}
            pdf = pdf.assign(term=pdf["term"].map(seen))[["term", "records"]]
            pdf = pdf[pdf["term"].notna()].explode("records").rename(columns={"records": "record"})
            pdf["times"] = pdf["record"].notna().astype("int64")
            yield pdf.groupby(["term", "record"], dropna=False, as_index=False)["times"].sum()

    return keyed.select("term", "records").mapInPandas(filled(local), "term string, record string, times long")


def count_terms(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(term, occurrences, n_records) of (term, record, times) pairs.

    occurrences counts every naming; n_records counts the distinct records that
    exist in known (one column, record).  A term without any has 0.
    """
    known = known.select(F.col("record")).where("record is not null").distinct().withColumn("known", F.lit(1))
    # Written once: the range partitioning reads its input twice.
    named = materialize(
        pairs.join(known, "record", "left").select("term", "record", "times", F.coalesce("known", F.lit(0)).alias("known"))
    )
    ordered = named.repartitionByRange("term", "record").sortWithinPartitions("term", "record")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            t, r = pdf["term"].to_numpy(object), pdf["record"].to_numpy(object)
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
            new[0] = (t[0], r[0]) != last
            last = (t[-1], r[-1])
            edge = np.ones(len(t), bool)
            edge[1:] = t[1:] != t[:-1]
            at = np.flatnonzero(edge)
            yield pd.DataFrame(
                {
                    "term": t[at],
                    "occurrences": np.add.reduceat(pdf["times"].to_numpy("int64"), at),
                    "n_records": np.add.reduceat(new * pdf["known"].to_numpy("int64"), at),
                }
            )

    scanned = ordered.mapInPandas(filled(runs), "term string, occurrences long, n_records long")
    return scanned.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))


def mark_terms(counts: DataFrame, total_records: int, rare_below: int = 3, common_percent: int = 5) -> DataFrame:
    """Adds mark: 'rare' below rare_below records, 'common' above common_percent
    of total_records, else null.  'rare' wins where both hold."""
    common = F.col("n_records") * 100 > F.lit(total_records) * common_percent
    return counts.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(common, "common"))
