"""Most similar vectors for every vector (problem 3).

Method: a permutation index.  A bounded sample of the vectors serves as pivots;
each vector is represented by its nearest pivots in order and posted in the
inverted files of the first of them.  Within a file, candidates are ranked by
the footrule distance of their permutations, and the better half is reranked by
the cosine in double precision.

How many pivots there are and in how many files a vector is posted is measured,
not fixed: the exact neighbours of a bounded sample of vectors are found by one
scan against all rows, and the cheapest index that brings the wanted share of
these pairs together is built.  So the recall does not fall as a table grows;
where vectors have no structure the files grow instead, up to FILE_ROWS rows.

Pivots are drawn from the data, so their density follows the vectors' and a
region with a third of the rows gets a third of the files.  Exact copies share
one posting per class and at most k + 1 of them are compared, so a group of
copies cannot swell a file.  Every row is posted; nothing is capped.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

log = logging.getLogger(__name__)

#: Bounds on the number of pivots (the sample of the index) and least vectors per pivot.
MIN_PIVOTS, MAX_PIVOTS, PER_PIVOT = 32, 65_536, 32
#: Vectors whose exact neighbours are looked up to choose the index.
SAMPLE = 256
#: Most files a vector may be posted in and most rows of a mean file.
MAX_FILES, FILE_ROWS = 48, 65_536
#: Length of a permutation; the sum of its weights must fit a byte.
PREFIX = 22
#: A file's candidates of a vector: its better half, this many at least.
CANDIDATES = 128
#: Measured microseconds to post a vector once, to compare a pair and to compare with a pivot.
POST_COST, PAIR_COST, PIVOT_COST = 15.0, 0.025, 0.01
BLOCK_PAIRS = 2_000_000
FILES_PER_TASK = 64


def sound_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v) of vectors with dim finite values that are not all zero.  Rows
    without key are left out; a key with several vectors keeps the greatest."""
    v = F.col(f"`{vector}`")
    good = (
        (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = df.where(F.col(f"`{key}`").isNotNull() & good).select(F.col(f"`{key}`").alias("key"), v.cast("array<float>").alias("v"))
    # Only keys and hashes are shuffled to find the keys that have more than one vector.
    several = materialize(
        rows.select("key", F.xxhash64("v").alias("h"))
        .groupBy("key")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key")
    )
    small = broadcast_if_small(several, 100_000)
    once = rows.join(small, "key", "left_anti")
    return once.unionByName(rows.join(small, "key", "left_semi").groupBy("key").agg(F.max("v").alias("v")))


def split_copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k + 1 keys of every class of equal vectors, and (left, right,
    similarity) of the other keys, whose nearest are the first k of their class."""
    many = materialize(
        rows.select(F.xxhash64("v").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h")
    )
    small = broadcast_if_small(many, 100_000)
    hashed = rows.withColumn("h", F.xxhash64("v"))
    crowded = hashed.join(small, "h", "left_semi")
    w = Window.partitionBy("h", "v").orderBy("key")
    first = crowded.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    kept = hashed.join(small, "h", "left_anti").select("key", "v").unionByName(first.select("key", "v"))
    heads = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    heads = broadcast_if_small(heads, 10_000)
    others = (
        crowded.join(heads, ["h", "v"])
        .where(~F.array_contains("heads", F.col("key")))
        .select(F.col("key").alias("left"), F.explode(F.slice("heads", 1, k)).alias("right"))
        .withColumn("similarity", F.lit(1.0))
    )
    return kept, others


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Normalised double vectors of an Arrow list column."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1)[:, None]


def pick(rows: DataFrame, seed: int, total: int, most: int, dim: int) -> tuple[list[str], np.ndarray]:
    """Keys and normalised vectors of most rows in the order of a hash of the key;
    most bounds what comes to the driver."""
    share = min(1.0, 2.0 * most / max(total, 1) + 64.0 / max(total, 1))
    place = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000_000))
    some = rows.where(place <= int(share * 1e9)).select(F.col("key").cast("string").alias("key"), "v", place.alias("p"))
    table = some.orderBy("p", "key").limit(most).toArrow().combine_chunks()
    if not table.num_rows:
        return [], np.empty((0, dim))
    return table.column("key").to_pylist(), unit_rows(table.column("v").combine_chunks(), dim)


def exact_neighbours(rows: DataFrame, keys: list[str], queries: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query number, vector) of the k most similar others of each query, by one
    scan of all rows; each batch keeps k of a query."""
    dim = queries.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((keys, queries))

    def scan(batches):
        keys, queries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column(1), dim)
            s = queries @ unit.T
            place = {x: i for i, x in enumerate(batch.column(0).cast(pa.string()).to_pylist())}
            for i, x in enumerate(keys):
                if x in place:
                    s[i, place[x]] = -2
            best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            q, c = np.repeat(np.arange(len(keys)), best.shape[1]), best.ravel()
            good = s[q, c] >= (-1.5 if least is None else least)
            q, c = q[good], c[good]
            vectors = pa.array([x.tobytes() for x in unit[c]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(s[q, c]), vectors], ["q", "s", "v"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    near = rows.select("key", "v").mapInArrow(scan, "q int, s double, v binary")
    got = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("q", "v").toArrow()
    found = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float64).reshape(-1, dim)
    return got.column("q").to_numpy(), found


def choose_index(
    pivots: np.ndarray, queries: np.ndarray, which: np.ndarray, near: np.ndarray, total: int, recall: float
) -> tuple[int, int, float]:
    """(number of pivots, files, share of the sampled pairs that meet): the
    cheapest index in which at least recall of the pairs share a file, or the one
    in which most do."""
    best, fallback = None, (MIN_PIVOTS, 1, -1.0)
    m = min(MIN_PIVOTS, len(pivots))
    while True:
        per = max(1.0, total / m)
        most = min(MAX_FILES, m, max(1, int(FILE_ROWS / per)))
        p = pivots[:m].astype(np.float32)
        a, b = (permutations(x.astype(np.float32), p, most) for x in (queries, near))
        need = np.full(len(near), MAX_FILES + 1)
        for low in range(0, len(near), 256):
            equal = a[which[low : low + 256]][:, :, None] == b[low : low + 256][:, None, :]
            later = np.maximum(np.arange(most)[:, None], np.arange(most)[None, :])
            need[low : low + 256] = np.where(equal, later, MAX_FILES).min((1, 2), initial=MAX_FILES) + 1
        for files in range(1, most + 1):
            met = float((need <= files).mean()) if len(near) else 1.0
            cost = files * POST_COST + files * files * per * PAIR_COST + m * PIVOT_COST
            if met > fallback[2]:
                fallback = (m, files, met)
            if met >= recall and files >= min(2, m):
                if best is None or cost < best[0]:
                    best = (cost, m, files, met)
                break
        if m >= min(len(pivots), max(MIN_PIVOTS, total // PER_PIVOT)):
            break
        m = min(2 * m, len(pivots))
    return best[1:] if best else fallback


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indices of the prefix most similar pivots of each vector, in order."""
    out = np.empty((len(vectors), prefix), np.int32)
    for low in range(0, len(vectors), 1024):
        s = vectors[low : low + 1024] @ pivots.T
        if prefix < s.shape[1]:
            near = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix]
        else:
            near = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        order = np.lexsort((near, -np.take_along_axis(s, near, 1)), axis=1)
        out[low : low + 1024] = np.take_along_axis(near, order, 1)
    return out


class Weights:
    """Permutations of a file as weights: the first pivot weighs prefix, the last
    1, others 0.  The sum of the smaller weights of two vectors is their
    agreement; the footrule distance of two prefixes is a constant less twice
    this, so the greatest agreement is the least footrule distance."""

    def __init__(self, perms: np.ndarray):
        known, local = np.unique(perms, return_inverse=True)
        self.local = local.reshape(perms.shape)
        self.scale = np.arange(perms.shape[1], 0, -1, dtype=np.uint8)[:, None]
        self.by_pivot = np.zeros((len(known), len(perms)), np.uint8)
        self.by_pivot[self.local.ravel(), np.repeat(np.arange(len(perms)), perms.shape[1])] = np.tile(self.scale[:, 0], len(perms))

    def agreement(self, row: int) -> np.ndarray:
        """Agreement of a row with all rows."""
        return np.minimum(self.by_pivot[self.local[row]], self.scale).sum(0, dtype=np.uint8)


def search_file(keys: np.ndarray, vectors: np.ndarray, perms: np.ndarray, k: int, least: float | None):
    """(left, right, similarity) arrays of the k best of each posted vector among
    its candidates in this file."""
    n = len(keys)
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    rank = np.empty(n, np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(n)
    wanted = max(CANDIDATES, n // 2)
    weights = Weights(perms) if n > wanted + 1 else None
    lefts, rights, sims = [], [], []
    step = max(1, BLOCK_PAIRS // n)
    for low in range(0, n, step):
        high = min(n, low + step)
        s = np.round(exact[low:high] @ exact.T, 12)  # so that copies tie whatever the order of summation
        s[np.arange(high - low), np.arange(low, high)] = -2
        if weights is not None:
            for i in range(low, high) if least is None else low + np.flatnonzero((s >= least).any(1)):
                agreement = weights.agreement(i)
                above = np.cumsum(np.bincount(agreement, minlength=256)[::-1])
                limit = 255 - int(np.searchsorted(above, wanted + 1))  # rows as near as the last candidate count too
                s[i - low, agreement < limit] = -2
        if least is None:
            best = np.argpartition(-s, min(k, n - 1), axis=1)[:, : k + 1] if n > k + 1 else np.broadcast_to(np.arange(n), s.shape)
            floor = np.take_along_axis(s, best, 1).min(1) if n > k + 1 else np.full(high - low, -1.5)
            i, c = np.nonzero(s >= np.maximum(floor, -1.5)[:, None])
        else:
            i, c = np.nonzero(s >= least)
        value = s[i, c]
        order = np.lexsort((rank[c], -value, i))
        i, c, value = i[order], c[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = place < k
        lefts.append(i[top] + low)
        rights.append(c[top])
        sims.append(value[top])
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(sims)


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, min_similarity: float | None = None, recall: float = 0.97
) -> DataFrame:
    """(left, right, similarity, place): the k most similar other keys of every
    key with a sound vector, equal similarity going to the smaller key.

    With min_similarity only pairs at least that similar are kept, which cannot
    change the places of those that are.  Approximate: a pair is found if the two
    vectors share one of their first pivots, which holds for at least recall of
    the sampled pairs unless MAX_FILES or FILE_ROWS forbid (then a warning names
    the share), and if one is in the better half of the file for the other.
    Empty tables and single vectors give no row.
    """
    rows = materialize(sound_vectors(df, key, vector, dim))
    kept, copies = split_copies(rows, k)
    total = rows.count()
    names, pivots = pick(kept, 1, total, min(MAX_PIVOTS, max(MIN_PIVOTS, total // PER_PIVOT)), dim)
    if not names:
        return copies.withColumn("place", F.lit(0)).where("false")
    asked, queries = pick(kept, 2, total, SAMPLE, dim)
    which, near = exact_neighbours(kept, asked, queries, k, min_similarity)
    m, files, met = choose_index(pivots, queries, which, near, total, recall)
    if met < recall:
        log.warning("only %.3f of the nearest pairs of %s share a file", met, key)
    pivots = pivots[:m].astype(np.float32)
    prefix = min(max(PREFIX, files), m)
    kept_prefix = min(PREFIX, m)
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS * dim * 4 bytes at most

    def post(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            unit = v / np.linalg.norm(v.astype(np.float64), axis=1)[:, None].astype(np.float32)
            p = permutations(unit, shared.value, prefix)
            at = np.repeat(np.arange(len(v)), files)
            blob = lambda a: pa.array([x.tobytes() for x in a], pa.binary()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p[:, :files].ravel()),
                    batch.column(0).cast(pa.string()).take(pa.array(at)),
                    blob(v),
                    blob(p[:, :kept_prefix].astype(np.uint16)),
                ],
                ["pivot", "key", "v", "p"],
            )

    posted = kept.select("key", "v").mapInArrow(post, "pivot int, key string, v binary, p binary")

    def search(table: pa.Table) -> pa.Table:
        raw = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        keys = np.array(table.column("key").to_pylist(), object)
        left, right, s = search_file(
            keys, raw("v", np.float32).reshape(-1, dim), raw("p", np.uint16).reshape(-1, kept_prefix), k, min_similarity
        )
        return pa.table({"left": pa.array(keys[left], pa.string()), "right": pa.array(keys[right], pa.string()), "similarity": s})

    # So many files to a task, whatever the size of the table.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m // FILES_PER_TASK))
    found = posted.repartition(tasks, "pivot").groupBy("pivot").applyInArrow(search, "left string, right string, similarity double")
    # A pair that meets in several files has one place; dropping the repeats needs no other shuffle.
    w = Window.partitionBy("left").orderBy(F.desc("similarity"), "right")
    placed = found.unionByName(copies).withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= k)
    return placed.dropDuplicates(["left", "right"])


def similar_pairs(directed: DataFrame) -> DataFrame:
    """(left_id, right_id) of pairs of which one is among the nearest of the other."""
    pair = [F.least("left", "right").alias("left_id"), F.greatest("left", "right").alias("right_id")]
    return directed.select(*pair).distinct()
