"""Session helpers: tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where that is
    unset (local tests) fall back to a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", "")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="procgraph-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and cut its lineage.

    Unlike localCheckpoint this survives the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting: above max_rows the join shuffles.

    Pass a materialized frame, else the count repeats the work.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def filled(function):
    """A mapInPandas function without its empty frames: some string types do not
    convert to Arrow when there is no row."""

    def run(batches):
        for pdf in function(batches):
            if len(pdf):
                yield pdf

    return run
