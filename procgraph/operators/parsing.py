"""Parsers of functions.mermaid applied to tables, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mermaid import diagrams, flowchart, graph_of, graph_of_json, keywords_and_code, qa_of, sequence
from ..functions.text import edge_type, node_type
from ..session import filled


def _map(df: DataFrame, key: str, cols: list[str], schema: str, rows_of) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in f"k {kind}|{schema}".split("|")]
        for pdf in batches:
            out = [(k, *r) for k, *values in pdf.itertuples(index=False) for r in rows_of(k, *values)]
            yield pd.DataFrame(out, columns=names)

    chosen = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    return chosen.mapInPandas(filled(apply), f"k {kind}, " + schema.replace("|", ", ")).withColumnRenamed("k", key)


def flowchart_nodes(df: DataFrame, key: str, code: str, chinese_only: bool = False) -> DataFrame:
    """M3, M4: (key, id, text, node_type, ord)."""
    rows = lambda k, c: [(i, t, kind, n) for n, (i, (t, kind)) in enumerate(flowchart(c, chinese_only).nodes.items())]
    return _map(df, key, [code], "id string|text string|node_type string|ord int", rows)


def flowchart_edges(df: DataFrame, key: str, code: str, chinese_only: bool = False, compat: bool = False) -> DataFrame:
    """M3, M4: (key, source_id, target_id, label, edge_style, ord)."""
    rows = lambda k, c: [(*e, n) for n, e in enumerate(flowchart(c, chinese_only, compat).edges)]
    return _map(df, key, [code], "source_id string|target_id string|label string|edge_style string|ord int", rows)


def sequence_messages(df: DataFrame, key: str, code: str) -> DataFrame:
    """M5: (key, sender, receiver, message, message_type, ord), by alias."""
    def rows(k, c):
        people, messages = sequence(c)
        return [(people[s], people[r], t, kind, n) for n, (s, r, t, kind) in enumerate(messages)]

    return _map(df, key, [code], "sender string|receiver string|message string|message_type string|ord int", rows)


def extract_diagrams(df: DataFrame, key: str, content: str) -> DataFrame:
    """M1: (key, flowchart, sequence) of model output."""
    rows = lambda k, c: [(d.get("flowchart"), d.get("sequence")) for d in [diagrams(c)]]
    return _map(df, key, [content], "flowchart string|sequence string", rows)


def keywords_and_codes(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, keywords, mermaid_code)."""
    return _map(df, key, [content], "keywords array<string>|mermaid_code string", lambda k, c: [keywords_and_code(c)])


def graph_rows(df: DataFrame, source_tg: str, flow: str, seq: str, chinese_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """M6-M8: nodes and edges of every document's diagrams; the parse runs once
    and its result is written, since both tables come from it."""
    def rows(k, f, s):
        nodes, edges = graph_of(f, s, k, chinese_only)
        return [("n", n, name, kind, p, None, None, None) for n, (name, kind, p, _) in enumerate(nodes)] + [
            ("e", n, a, kind, None, b, label, None) for n, (a, b, kind, label) in enumerate(edges)
        ]

    schema = "part string|ord long|a string|kind string|properties map<string,string>|b string|label string|extra string"
    return _split(_map(df, source_tg, [flow, seq], schema, rows), source_tg)


def json_graph_rows(df: DataFrame, source_tg: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of model output."""
    def rows(k, c):
        parsed = graph_of_json(c, k)
        nodes, edges = parsed or ([], [])
        return [("n", n, name, kind, p, None, None, None) for n, (name, kind, p, _) in enumerate(nodes)] + [
            ("e", n, a, kind, None, b, label, None) for n, (a, b, kind, label) in enumerate(edges)
        ]

    schema = "part string|ord long|a string|kind string|properties map<string,string>|b string|label string|extra string"
    nodes, edges = _split(_map(df, source_tg, [content], schema, rows), source_tg)
    nodes = nodes.withColumn("node_type", node_type(F.col("node_type")))
    return nodes, edges.withColumn("edge_type", edge_type(F.col("edge_type"), F.col("relation_name")))


def _split(parsed: DataFrame, source_tg: str) -> tuple[DataFrame, DataFrame]:
    tg = F.col(f"`{source_tg}`").cast("string")
    nodes = parsed.where("part = 'n'").select(
        F.col("a").alias("name"), F.col("kind").alias("node_type"), "properties", F.array(tg).alias("source_tg"), "ord"
    )
    edges = parsed.where("part = 'e'").select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.col("kind").alias("edge_type"), F.col("label").alias("relation_name"),
        F.lit(1.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"),
        tg.alias("source_tg"), "ord",
    )
    return nodes, edges


def qa_rows(df: DataFrame, source_doc: str, response: str) -> DataFrame:
    """Question and answer rows of generated JSON."""
    cols = ["id", "question", "answer", "question_type", "difficulty", "need_text_knowledge", "related_nodes", "evidence", "analysis"]
    rows = lambda k, c: [tuple(r[x] for x in cols) for r in qa_of(c, k)]
    schema = (
        "id string|question string|answer string|question_type string|difficulty string|"
        "need_text_knowledge boolean|related_nodes array<string>|evidence string|analysis string"
    )
    return _map(df, source_doc, [response], schema, rows)
