"""Vector search for a batch of queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Queries in one broadcast.
MAX_QUERIES = 20_000
DIGITS = 6


def match_metadata(metadata: str, wanted: dict[str, str]) -> Column:
    """All wanted entries are equal; a missing key is unequal."""
    m = F.col(metadata)
    tests = [F.try_element_at(m, F.lit(k)).eqNullSafe(F.lit(v)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def query_block(queries: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of a block of at most about MAX_QUERIES queries (query_id, q)."""
    rows = queries.select("query_id", "q").where("q is not null").collect()
    if not rows:
        return [], np.zeros((0, 0))
    rows.sort(key=lambda r: str(r.query_id))
    q = np.array([r.q for r in rows], np.float64).reshape(len(rows), -1)
    length = np.linalg.norm(q, axis=1)
    keep = length > 1e-12
    return [r.query_id for r, k in zip(rows, keep) if k], q[keep] / length[keep][:, None]


def local_best(queries: DataFrame, items: DataFrame, k: int | None, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score): the k best items of each query in every Arrow batch
    (all with k None), by cosine in double precision.

    Items are scanned once where they lie; what leaves a batch is k rows per
    query, not one per pair.  More than MAX_QUERIES queries go in blocks, each in
    a scan of its own whose result is written before the next is collected.  Zero
    queries and vectors of another length, zero or with missing values give no row.
    """
    times = -(-queries.count() // MAX_QUERIES)
    if times > 1:
        found = None
        for n in range(times):
            block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(times)) == n)
            part = materialize(_local_best(block, items, k, digits))
            found = part if found is None else found.unionByName(part)
        return found
    return _local_best(queries, items, k, digits)


def _local_best(queries: DataFrame, items: DataFrame, k: int | None, digits: int) -> DataFrame:
    ids, q = query_block(queries)
    kinds = queries.schema["query_id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not ids:
        return items.sparkSession.createDataFrame([], schema)
    dim = q.shape[1]
    block = items.sparkSession.sparkContext.broadcast((ids, q))
    good = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))

    def best(batches):
        ids, q = block.value
        names = pa.array(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            length = np.linalg.norm(v, axis=1)
            score = np.round(q @ (v / np.maximum(length, 1e-300)[:, None]).T, digits)
            score[:, length < 1e-12] = -np.inf
            if k is None or k >= score.shape[1]:
                a, b = np.nonzero(score > -np.inf)
            else:  # ties at the cut stay, the window decides them by id
                cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                a, b = np.nonzero((score >= cut) & (score > -np.inf))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(a)), batch.column(0).take(pa.array(b)), pa.array(score[a, b])],
                ["query_id", "id", "score"],
            )

    return items.where(good).select("id", "v").mapInArrow(best, schema)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """K1, K3-K6: the k best of every query with rank; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    where: Column | None = None,
    overfetch: int | None = None,
    least: float | None = None,
) -> DataFrame:
    """Cosine top-k per query over items (id, v, ...).

    where filters items before the cut; with overfetch it filters the k *
    overfetch best instead, then cuts.  least filters after the cut.
    """
    if where is not None and overfetch is not None:
        wide = top_k(local_best(queries, items, k * overfetch), k * overfetch).drop("rank")
        found = top_k(wide.join(items.where(where).select("id"), "id", "left_semi"), k)
    else:
        rows = items if where is None else items.where(where)
        found = top_k(local_best(queries, rows, k), k)
    return found.where(F.col("score") >= least) if least is not None else found
