"""Continuous ingestion of text files into chunks (an addition to the batch build).

A file source with a checkpoint sees each new file once; each micro-batch goes
through the same operators as the batch build, and its output path depends on the
batch alone, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.splitters import Splitter, chunks_of_files


def stream_texts(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_trigger: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    name = F.col("_metadata.file_name")
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        name.alias("source_file"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("tg_id"),
        F.col("value").alias("text"),
    )


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, splitter: Splitter, pattern: str = "*.txt") -> StreamingQuery:
    """Write the chunks of new files below out/batch=N until all present files are done."""
    def sink(batch: DataFrame, number: int) -> None:
        chunks_of_files(batch, splitter).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream_texts(spark, folder, pattern)
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
