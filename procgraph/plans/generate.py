"""Model-backed generation over tables (M13-M15, M19, B16, V14): a prompt column, a
provider in Arrow batches, and a parser.  Errors are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid_mermaid
from ..functions.vectors import cosine
from ..operators import parsing
from ..providers import EmbeddingProvider, LanguageModel, embed_column, map_column
from ..session import materialize

DIAGRAM_PROMPT = (
    "Turn the procedure below into a flowchart.  Answer with JSON that has the fields keywords (a list of terms) and "
    "mermaid_code (a Mermaid flowchart whose nodes carry the full text of each step).\n\nProcedure:\n"
)
GRAPH_PROMPT = (
    "Extract the graph of the procedure below.  Answer with JSON that has the fields nodes (id, name, type) and edges "
    "(source, target, relation).\n\nProcedure:\n"
)
QA_PROMPT = (
    "Write question and answer pairs about the procedure below.  Answer with a JSON array of objects with the fields "
    "category, question, answer, analysis (reason, evidence), difficulty and related_nodes.\n\nProcedure:\n"
)
DEVICE_PROMPT = 'Name the system or device that the question is about.  Answer with JSON: {"system_device": "..."}\n\nQuestion: '


def ask(df: DataFrame, key: str, text: str, prompt: str, model: LanguageModel) -> DataFrame:
    """(key, output, success, error_message) of the model for every text; written
    once, so that a model is never asked twice for one row."""
    asked = df.select(F.col(f"`{key}`"), F.concat(F.lit(prompt), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("prompt"))
    return materialize(map_column(asked, key, "prompt", model.complete))


def diagrams(docs: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """(key, keywords, mermaid_code, success, error_message); output without
    a valid diagram is a failure."""
    told = ask(docs, key, text, DIAGRAM_PROMPT, model)
    parsed = parsing.keywords_and_codes(told.where("success"), key, "output")
    good = valid_mermaid(F.col("mermaid_code"))
    return told.join(parsed, key, "left").select(
        F.col(f"`{key}`"), "keywords", F.when(good, F.col("mermaid_code")).alias("mermaid_code"),
        (F.col("success") & F.coalesce(good, F.lit(False))).alias("success"),
        F.when(F.col("success") & ~F.coalesce(good, F.lit(False)), "no valid diagram").otherwise(F.col("error_message")).alias("error_message"),
    )


def graph(docs: DataFrame, key: str, text: str, model: LanguageModel) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of model output; a text whose output holds no
    graph JSON falls back on the diagrams in it, read by rules (Q-07)."""
    told = ask(docs, key, text, GRAPH_PROMPT, model).where("success")
    nodes, edges = parsing.json_graph_rows(told, key, "output")
    nodes, edges = materialize(nodes), materialize(edges)
    silent = told.join(nodes.select(F.col("source_tg")[0].alias(key)).distinct(), key, "left_anti")
    codes = parsing.extract_diagrams(silent, key, "output")
    more_nodes, more_edges = parsing.graph_rows(codes, key, "flowchart", "sequence", chinese_only=False)
    return nodes.unionByName(more_nodes), edges.unionByName(more_edges)


def questions(docs: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """Question and answer rows of every distinct document."""
    return parsing.qa_rows(ask(docs.dropDuplicates([key]), key, text, QA_PROMPT, model).where("success"), key, "output")


def devices(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """(query_id, core_event, system_device): the question itself and the
    device named in the model's JSON, empty where there is none."""
    told = ask(asked, "query_id", "question", DEVICE_PROMPT, model)
    field = F.get_json_object(F.regexp_extract("output", r"(?s)\{.*\}", 0), "$.system_device")
    return asked.join(told, "query_id").select(
        "query_id", F.col("question").alias("core_event"), F.coalesce(field, F.lit("")).alias("system_device")
    )


def keyword_boost(devices: DataFrame, candidates: DataFrame, keywords: DataFrame, embedder: EmbeddingProvider) -> DataFrame:
    """(query_id, id, boost): cosine of a query's device with the joined
    keywords of its candidates (query_id, id); keywords is (id, keywords array).
    Queries without device and nodes without keywords have no row."""
    dev = embed_column(devices.where("system_device <> ''"), "query_id", "system_device", embedder, as_query=True)
    joined: Column = F.array_join("keywords", " ")
    wanted = keywords.join(candidates.select("id").distinct(), "id", "left_semi").where(F.size("keywords") > 0)
    kw = embed_column(wanted.select("id", joined.alias("t")), "id", "t", embedder).withColumnRenamed("v", "k")
    return (
        candidates.select("query_id", "id").distinct().join(dev, "query_id").join(kw, "id")
        .select("query_id", "id", F.round(cosine(F.col("v"), F.col("k")), 6).alias("boost"))
    )
