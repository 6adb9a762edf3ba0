"""Readers and writers of text, diagrams, graphs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.curation import batch_schema


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file_path, source_file, tg_id, text, file_size, modified_time), one
    row per file; tg_id is the file's stem.  A folder without files gives none."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    name = F.col("_metadata.file_name")
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        name.alias("source_file"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("tg_id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_time"),
    )


def graph_json_schema() -> str:
    node = (
        "struct<name:string,node_type:string,properties:map<string,string>,source_tg:array<string>,predecessors:array<string>,"
        "successors:array<string>,enrichment_chunks:array<string>,enrichment_text:string>"
    )
    edge = (
        "struct<source_id:string,target_id:string,edge_type:string,relation_name:string,confidence:double,"
        "properties:map<string,string>,source_tg:string>"
    )
    return f"nodes map<string,{node}>, edges array<{edge}>, metadata map<string,string>"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph JSON files; ord is an edge's position."""
    raw = spark.read.schema(graph_json_schema()).option("multiLine", True).json(path)
    nodes = raw.select(F.explode(F.map_values("nodes")).alias("n")).select("n.*")
    edges = raw.select(F.posexplode("edges").alias("ord", "e")).select(
        F.col("e.source_id").alias("src"), F.col("e.target_id").alias("dst"), "e.edge_type", "e.relation_name",
        F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"), "e.properties", "e.source_tg", F.col("ord").cast("long"),
    )
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables, replacing what is there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines of nodes and edges (one object per line, any size)."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored graph, empty tables where there is none."""
    return read_table(spark, f"{path}/nodes", schemas.NODES), read_table(spark, f"{path}/edges", schemas.EDGES)


def write_diagrams(codes: DataFrame, path: str) -> None:
    """(tg_id, flowchart, sequence) by kind, with a heading per document."""
    stacked = codes.select("tg_id", F.explode(F.create_map(F.lit("flowchart"), "flowchart", F.lit("sequence"), "sequence")).alias("kind", "code"))
    body = F.concat_ws("\n", F.concat(F.lit("%% document: "), F.col("tg_id")), "code")
    stacked.where("code <> ''").select("tg_id", "kind", body.alias("code")).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    """(tg_id, kind, code) of *.mmd files by their suffix."""
    raw = read_texts(spark, folder, "*.mmd")
    return raw.select(
        F.regexp_replace("tg_id", r"_(flowchart|sequence|mermaid)$", "").alias("tg_id"),
        F.regexp_extract("tg_id", r"_(flowchart|sequence|mermaid)$", 1).alias("kind"),
        F.col("text").alias("code"),
    )


def read_batches(spark: SparkSession, folder: str, pattern: str = "BATCH-*.json") -> DataFrame:
    """(id, title, qa_pairs) of batch files; a broken file gives nulls."""
    return (
        spark.read.schema(batch_schema()).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)
    )


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there."""
    df.write.mode("overwrite").json(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(name, v) of a driver-side npz file with node_ids and embeddings; for
    moving a small store over, not for data of any size."""
    import numpy as np

    with np.load(path, allow_pickle=True) as z:
        rows = [(str(n), [float(x) for x in v]) for n, v in zip(z["node_ids"], z["embeddings"])]
    return spark.createDataFrame(rows, "name string, v array<float>")
