"""Queries of problem 4."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, read
from .ledger import WorkLedger, claim, complete, enqueue, expire, history, lease, listed, plan_work

NOW, LATER = "2026-01-01 00:00:00", "2026-01-01 02:00:00"


def _at(time: str) -> Column:
    return F.lit(time).cast("timestamp")


def _ledger(spark: SparkSession, d: str) -> WorkLedger:
    """A ledger in the shared folder that knows the log of all builds so far."""
    store = WorkLedger(spark, f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}")
    store.update(lambda s: enqueue(s, history(read(spark, d, "file_records"))))
    return store


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that the next build has to process: what it leases from the ledger
    after a build that leased everything died and its leases ended."""
    store, listing = _ledger(spark, d), read(spark, d, "file_listing")
    claim(store, listing, "builder-1", _at(NOW), 3600)
    return claim(store, listing, "builder-2", _at(LATER), 3600).select(F.col("item").alias("file_name"))


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    """Ledger states after a build that leased all work, finished half of it by
    name and died: the other half's leases expire and come back as pending."""
    work = plan_work(read(spark, d, "file_listing"), read(spark, d, "file_records"))
    leased = lease(work, "builder-1", _at(NOW), 3600)
    first_half = F.conv(F.substring(F.md5("item"), 1, 1), 16, 10).cast("int") < 8
    after = expire(complete(leased, leased.where(first_half & (F.col("state") == "leased"))), _at(LATER))
    again = enqueue(after, work)
    return again.groupBy("state", "token").agg(F.count("*").alias("n_files"))


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Committed states of the listed files after a build that finished the first
    half by name and died, a second that finished the rest, and results of the
    first that came too late."""
    store, listing = _ledger(spark, d), read(spark, d, "file_listing")
    first = claim(store, listing, "builder-1", _at(NOW), 3600)
    first_half = F.conv(F.substring(F.md5("item"), 1, 1), 16, 10).cast("int") < 8
    done = first.where(first_half)
    store.update(lambda s: complete(s, done), items=done)
    second = claim(store, listing, "builder-2", _at(LATER), 3600)
    store.update(lambda s: complete(s, first))  # stale tokens
    state = store.update(lambda s: complete(s, second))
    named = state.join(listed(listing).select("item"), "item", "left_semi")
    return named.groupBy("state", "token").agg(F.count("*").alias("n_files"))


QUERIES = {"p4_found": p4_found, "p4_states": p4_states, "p4_ledger": p4_ledger}

_PLANNED = """
WITH cur AS (
  SELECT item, arg_max({size: file_size, mtime: modified_time}, {t: listed_at, s: file_size, m: modified_time}) AS r
  FROM (SELECT *, regexp_extract(file_path, '([^/\\\\]*)$', 1) AS item FROM file_listing WHERE file_path IS NOT NULL)
  GROUP BY item),
ok AS (
  SELECT item, arg_max({size: file_size, mtime: modified_time}, {t: processed_time, s: file_size, m: modified_time}) AS r
  FROM (SELECT *, regexp_extract(file_path, '([^/\\\\]*)$', 1) AS item FROM file_records
        WHERE file_path IS NOT NULL AND success)
  GROUP BY item),
planned AS (
  SELECT cur.item, ok.item IS NULL OR cur.r.size IS DISTINCT FROM ok.r.size
         OR (cur.r.mtime IS NULL) <> (ok.r.mtime IS NULL)
         OR coalesce(abs(cur.r.mtime - ok.r.mtime) >= 2, false) AS changed
  FROM cur LEFT JOIN ok USING (item))
"""

SQL = {
    "p4_found": _PLANNED + "SELECT item AS file_name FROM planned WHERE changed",
    "p4_states": _PLANNED
    + """
SELECT CASE WHEN NOT changed OR md5(item)[1] < '8' THEN 'done' ELSE 'pending' END AS state,
       CAST(changed AS BIGINT) AS token, count(*) AS n_files
FROM planned GROUP BY 1, 2""",
    "p4_ledger": _PLANNED
    + """
, seen AS (SELECT planned.*, ok.item IS NOT NULL AS known FROM planned LEFT JOIN ok USING (item))
SELECT 'done' AS state, CASE WHEN NOT changed THEN 0 ELSE CAST(known AS BIGINT) + CASE WHEN md5(item)[1] < '8' THEN 1 ELSE 2 END END AS token,
       count(*) AS n_files
FROM seen GROUP BY 1, 2""",
}
