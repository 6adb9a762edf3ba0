"""Processing only new or changed records (problem 4).

Method: a work-item ledger with the states pending, leased and done.  Expired
leases return to pending, fencing tokens reject stale writers, and output paths
that depend only on the item and its version absorb retries.

The transitions are functions from DataFrame to DataFrame.  `WorkLedger` keeps
their results as numbered snapshots in a folder that all drivers share.  A
snapshot is a manifest that names a data folder for each bucket of items, so an
update writes only the buckets it touches.  It counts once its manifest has been
published under its number, which fails if that number is taken: of two drivers
that write the same number one wins and the other starts again from the newer
state.  Manifests are written whole before they are published, so a driver that
stalls or dies leaves none behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, LEASED, DONE = "pending", "leased", "done"
SCHEMA = (
    "item string, size long, mtime double, version string, state string, token long, owner string, "
    "lease_until timestamp, output string"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
TOLERANCE_S = 2.0


def base_name(path: Column) -> Column:
    """The part after the last / or \\."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def current_files(listing: DataFrame) -> DataFrame:
    """(item, size, mtime) of each file's row with the latest listed_at; equal
    times go to the greater size, then the later modification.  Rows without
    path are left out; a path that ends in a separator names the empty file."""
    row = F.struct("listed_at", F.col("file_size").alias("size"), F.col("modified_time").alias("mtime"))
    return (
        listing.where("file_path is not null")
        .select(base_name(F.col("file_path")).alias("item"), row.alias("row"))
        .groupBy("item")
        .agg(F.max("row").alias("row"))
        .select("item", "row.size", "row.mtime")
    )


def last_success(records: DataFrame) -> DataFrame:
    """(item, size, mtime) of each file's successful row with the latest
    processed_time; a missing success is no success."""
    row = F.struct("processed_time", F.col("file_size").alias("size"), F.col("modified_time").alias("mtime"))
    return (
        records.where("success and file_path is not null")
        .select(base_name(F.col("file_path")).alias("item"), row.alias("row"))
        .groupBy("item")
        .agg(F.max("row").alias("row"))
        .select("item", F.col("row.size").alias("done_size"), F.col("row.mtime").alias("done_mtime"), F.lit(True).alias("seen"))
    )


def changed(size: Column, mtime: Column, old_size: Column, old_mtime: Column, tolerance_s: float = TOLERANCE_S) -> Column:
    """Another size, or a modification time tolerance_s or more away.  A size or
    time that is missing on one side only is a change; NaN equals NaN."""
    far = ~(F.abs(mtime - old_mtime) < tolerance_s)
    both_nan = F.isnan(mtime) & F.isnan(old_mtime)
    return (
        ~size.eqNullSafe(old_size)
        | (mtime.isNull() != old_mtime.isNull())
        | F.coalesce(far & ~both_nan, F.lit(False))
    )


def _rows(files: DataFrame, state: Column) -> DataFrame:
    """Ledger rows, never leased, of (item, size, mtime, ...)."""
    version = F.concat_ws(":", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.select(
        "item",
        "size",
        "mtime",
        version.alias("version"),
        state.alias("state"),
        F.lit(0).cast("long").alias("token"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(None).cast("timestamp").alias("lease_until"),
        output_path(F.col("item"), version).alias("output"),
    )


def history(records: DataFrame) -> DataFrame:
    """Ledger of a log of attempts: the files that succeeded, done as they were then."""
    done = last_success(records).select("item", F.col("done_size").alias("size"), F.col("done_mtime").alias("mtime"))
    return _rows(done, F.lit(DONE))


def listed(listing: DataFrame) -> DataFrame:
    """Work of a listing: its files as they are, pending."""
    return _rows(current_files(listing), F.lit(PENDING))


def plan_work(listing: DataFrame, records: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """A fresh ledger: one row per listed file, done where the last success has
    its size and a modification time less than tolerance_s away, else pending.

    Both inputs are reduced to a row per file before they are joined, so a file
    with many attempts does not skew the join.
    """
    new = changed(F.col("size"), F.col("mtime"), F.col("done_size"), F.col("done_mtime"), tolerance_s)
    both = current_files(listing).join(last_success(records), "item", "left")
    return _rows(both, F.when(F.col("seen").isNull() | new, PENDING).otherwise(DONE))


def output_path(item: Column, version: Column) -> Column:
    """Where the result of an item's version goes, whoever writes it and how
    often: a retry overwrites the same place."""
    digest = F.sha2(F.concat_ws("\u0000", item, version), 256)
    return F.concat(F.lit("part="), F.substring(digest, 1, 2), F.lit("/"), digest)


def enqueue(ledger: DataFrame, work: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """Ledger after a new plan: unknown items and changed ones take the plan's
    state (an item that changed while it was leased too; its token grows, so the
    old writer is rejected); everything else keeps its own, and items that the
    plan does not name stay."""
    old = ledger.select("item", *[F.col(c).alias(f"old_{c}") for c in ledger.columns if c != "item"])
    both = work.join(old, "item", "full_outer")
    new = changed(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime"), tolerance_s)
    fresh = F.col("version").isNotNull() & (F.col("old_version").isNull() | new)
    keep = {
        c: F.when(fresh, F.col(c)).otherwise(F.coalesce(F.col(f"old_{c}"), F.col(c)))
        for c in ("size", "mtime", "version", "state", "output")
    }
    keep["size"] = F.when(fresh, F.col("size")).otherwise(F.col("old_size"))
    keep["mtime"] = F.when(fresh, F.col("mtime")).otherwise(F.col("old_mtime"))
    keep["token"] = F.coalesce("old_token", F.lit(0)) + (fresh & F.col("old_version").isNotNull()).cast("long")
    keep["owner"], keep["lease_until"] = F.when(~fresh, F.col("old_owner")), F.when(~fresh, F.col("old_lease_until"))
    return both.select("item", *[keep[c].alias(c) for c in COLUMNS[1:]])


def expire(ledger: DataFrame, now: Column) -> DataFrame:
    """Leases that ended by now return to pending."""
    over = (F.col("state") == LEASED) & (F.col("lease_until") <= now)
    return ledger.withColumns(
        {
            "state": F.when(over, PENDING).otherwise(F.col("state")),
            "owner": F.when(~over, F.col("owner")),
            "lease_until": F.when(~over, F.col("lease_until")),
        }
    )


def lease(ledger: DataFrame, owner: str, now: Column, seconds: int, share: Column | None = None) -> DataFrame:
    """Lease pending items (those where share holds, else all) to owner.  Each
    lease raises the item's fencing token."""
    take = (F.col("state") == PENDING) & (share if share is not None else F.lit(True))
    until = (now.cast("double") + seconds).cast("timestamp")
    return ledger.withColumns(
        {
            "token": F.col("token") + take.cast("long"),
            "state": F.when(take, LEASED).otherwise(F.col("state")),
            "owner": F.when(take, F.lit(owner)).otherwise(F.col("owner")),
            "lease_until": F.when(take, until).otherwise(F.col("lease_until")),
        }
    )


def complete(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger after results (item, token) of finished work.  A result whose token
    is not the item's present one comes from a stale writer and is ignored, as
    are results for unknown items and repeated results."""
    valid = results.select("item", "token", F.lit(True).alias("ok")).distinct()
    done = (F.col("state") == LEASED) & F.col("ok").isNotNull()
    return (
        ledger.join(valid, ["item", "token"], "left")
        .withColumns(
            {
                "state": F.when(done, DONE).otherwise(F.col("state")),
                "owner": F.when(~done, F.col("owner")),
                "lease_until": F.when(~done, F.col("lease_until")),
            }
        )
        .select(*ledger.columns)
    )


def publish(spark: SparkSession, written: str, target: str) -> bool:
    """Give a written file its name unless that is taken; False if it is.

    Atomic on local folders (a hard link) and where the file system renames
    atomically without replacing, as HDFS does.  Object stores do not: pass
    WorkLedger a publisher of your own there, such as a conditional put."""
    jvm = spark._jvm
    path, goal = jvm.org.apache.hadoop.fs.Path(written), jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(goal), local(path))
        else:
            none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(path, goal, none)
    except Exception:  # noqa: BLE001 - another driver was first
        return False
    return True


class WorkLedger:
    """Snapshots of a ledger below path, changed by compare-and-swap.

    buckets is fixed when the first snapshot is written.  Data of snapshots older
    than the last keep is removed; keep must cover the longest reader.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        abandoned_s: float = 60.0,
        buckets: int = 16,
        keep: int = 8,
        publisher: Callable[[SparkSession, str, str], bool] = publish,
    ):
        self.spark, self.path, self.abandoned_s = spark, path.rstrip("/"), abandoned_s
        self.buckets, self.keep, self.publisher = buckets, keep, publisher
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self) -> dict[int, object]:
        folder = self._at(f"{self.path}/_commits")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return {int(s.getPath().getName()): s for s in found if s.getPath().getName().isdigit()}

    def head(self) -> int:
        """Number of the newest committed snapshot; 0 before the first.  An empty
        marker is no commit of ours and is removed after a while."""
        for number, status in sorted(self._markers().items(), reverse=True):
            if status.getLen() > 0:
                return number
            if time.time() - status.getModificationTime() / 1000 > self.abandoned_s:
                self._fs.delete(status.getPath(), False)
        return 0

    def _manifest(self, number: int) -> dict:
        """{"buckets": count, "data": {bucket: folder}} of a snapshot."""
        if not number:
            return {"buckets": self.buckets, "data": {}}
        marker = self._fs.open(self._at(f"{self.path}/_commits/{number:012d}"))
        try:
            return json.loads(marker.readUTF())
        finally:
            marker.close()

    def _frame(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = [b for b in manifest["data"] if buckets is None or int(b) in buckets]
        paths = sorted(f"{self.path}/{manifest['data'][b]}/bucket={b}" for b in wanted)
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        return self._frame(self._manifest(self.head()))

    def update(
        self, change: Callable[[DataFrame], DataFrame], attempts: int = 20, items: DataFrame | None = None
    ) -> DataFrame:
        """Commit change(state) as the next snapshot and return it.  A lost race
        runs change again on the winner's state.

        With items (column item) only their buckets are read and written: change
        sees the state of those, and the others stay as they are."""
        for _ in range(attempts):
            number = self.head()
            old = self._manifest(number)
            bucket = F.pmod(F.xxhash64("item"), F.lit(old["buckets"])).cast("int")
            touched = None
            if items is not None:
                touched = [r.b for r in items.select(bucket.alias("b")).distinct().collect()]
            name = f"data-{number + 1:012d}-{uuid.uuid4().hex}"
            rows = change(self._frame(old, touched)).select(*COLUMNS, bucket.alias("bucket"))
            rows.repartition(old["buckets"], "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            written = {
                s.getPath().getName().partition("=")[2]
                for s in self._fs.listStatus(self._at(f"{self.path}/{name}"))
                if s.getPath().getName().startswith("bucket=")
            }
            kept = {} if touched is None else {b: d for b, d in old["data"].items() if int(b) not in touched}
            new = {"buckets": old["buckets"], "data": kept | {b: name for b in written}}
            if self._commit(number + 1, new):
                self._clean(number + 1)
                return self._frame(new)
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        raise RuntimeError("the ledger is changed too often by others")

    def _commit(self, number: int, manifest: dict) -> bool:
        """Write the manifest whole, publish it under its number and read it back."""
        folder = f"{self.path}/_commits"
        self._fs.mkdirs(self._at(folder))
        written = f"{folder}/written-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(written), False)
        out.writeUTF(json.dumps(manifest))
        out.close()
        won = self.publisher(self.spark, written, f"{folder}/{number:012d}")
        if self._fs.exists(self._at(written)):
            self._fs.delete(self._at(written), False)
        return won and self._manifest(number) == manifest

    def _clean(self, number: int) -> None:
        """Remove data that only snapshots before the last keep name."""
        numbers = sorted(self._markers())
        used = {d for n in numbers if n > number - self.keep for d in self._manifest(n)["data"].values()}
        for n in numbers:
            if n <= number - self.keep:
                for d in set(self._manifest(n)["data"].values()) - used:
                    self._fs.delete(self._at(f"{self.path}/{d}"), True)
                self._fs.delete(self._at(f"{self.path}/_commits/{n:012d}"), False)


def claim(store: WorkLedger, listing: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """One run's work: leases that ended return to pending, new and changed files
    of the listing are added, and what is pending is leased to owner.  Returns
    the leased rows (item, token, output, ...) of this owner.

    Each step is committed by itself, so a driver may die between any two: the
    next run finds what is left, and results with an old token are rejected."""
    store.update(lambda s: enqueue(expire(s, now), listed(listing)))
    state = store.update(lambda s: lease(s, owner, now, seconds))
    return state.where((F.col("state") == LEASED) & (F.col("owner") == owner))
