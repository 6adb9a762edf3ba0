import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from procgraph import providers, schemas
from procgraph.functions.splitters import Splitter
from procgraph.plans.build import build
from procgraph.plans.config import BuildConfig, RetrievalConfig
from procgraph.plans.retrieval import Retriever, Store
from procgraph.sources import files
from procgraph.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = {
    "TG-1": "# Pump - start\n\nOpen the suction valve before the pump is started.\n\nThe pump must not run dry for more than 20 seconds.",
    "TG-2": "# Pump - stop\n\nClose the discharge valve slowly and wait for 30 seconds.\n\nRecord the oil level in the shift book.",
}
CODES = {
    "start": "```mermaid\nflowchart TD\nA[Open suction valve] --> B[Start pump]\nB --> C[Record oil level]\n```",
    "stop": "flowchart TD\nA[Close discharge valve] --> B[Stop pump]\nB --> C[Record oil level]",
}


def generate(text):
    title = text.split("\n")[0]
    if "broken" in title:
        raise RuntimeError("no output")
    return CODES["start" if "start" in title else "stop"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    for k, v in TEXTS.items():
        (d / f"{k}.txt").write_text(v)
    (d / "TG-3.txt").write_text("# broken")
    (d / "other.md").write_text("x")
    return str(d)


@pytest.fixture(scope="module")
def store(spark, folder):
    return build(files.read_texts(spark, folder), providers.HashEmbedding(), generate)


def test_build(store, collect):
    s, outcome = store
    assert collect(outcome, "item", "success") == [("TG-1", True), ("TG-2", True), ("TG-3", False)]
    assert s.nodes.count() == 5 and s.edges.count() == 4 and s.node_vec.count() == 5
    assert {tuple(r.source_tg) for r in s.nodes.where("name = 'Record oil level'").collect()} == {("TG-1", "TG-2")}
    own = s.mounts.join(s.chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").join(s.nodes, "name")
    assert own.where("not array_contains(source_tg, tg_id)").count() == 0
    assert s.chunk_kw.groupBy("chunk_id").count().where("count > 5").count() == 0


@pytest.mark.parametrize("strategy", ["full_context", "step_by_step"])
def test_retrieval(spark, store, strategy):
    r = Retriever(store[0], providers.HashEmbedding(), RetrievalConfig(keyword_threshold=0.3, strategy=strategy))
    asked = r.questions(spark.createDataFrame([("q1", "How is the suction valve opened?"), ("q2", "What about the oil level?")], "query_id string, question string"))
    got = {(x.query_id, x["rank"]): x.id for x in r.retrieve(asked, "hybrid", 3).collect()}
    assert got["q1", 1] == "Open suction valve" and got["q2", 1] == "Record oil level"
    assert r.retrieve(asked, "graph", 2).count() == 4
    answers = {x.query_id: x.output for x in r.answer(asked).collect()}
    assert answers == {"q1": "Open the suction valve before the pump is started.", "q2": "Record the oil level in the shift book."}
    paths = [x.path for x in r.walk(asked)["paths"].collect()]
    assert len(paths) == 4 and all(len(p) == len(set(p)) for p in paths)
    with pytest.raises(ValueError):
        r.retrieve(asked, "?")


def test_budget_bounds_the_context(spark, store):
    r = Retriever(store[0], providers.HashEmbedding(), RetrievalConfig(context_tokens=380))
    asked = r.questions(spark.createDataFrame([("q1", "How is the suction valve opened?")], "query_id string, question string"))
    out = r.reasoning(asked)
    assert all(x.tokens <= 30 for x in r.assemble(out["context"], out["paths"]).collect())


def test_no_context_is_said_without_a_model_call(spark, store):
    class Failing(providers.LanguageModel):
        def complete(self, prompt):
            raise AssertionError("called")

    r = Retriever(store[0], providers.HashEmbedding(), RetrievalConfig(context_tokens=10), Failing())
    asked = r.questions(spark.createDataFrame([("q1", "valve?")], "query_id string, question string"))
    assert r.answer(asked, "hybrid").first().output.startswith("无法回答")


def test_settings_are_checked():
    for bad in ({"hops": 0}, {"strategy": "x"}, {"top_k": 0}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)
    with pytest.raises(ValueError):
        BuildConfig(gamma=2)


def test_sources(spark, tmp_path, store, collect):
    s, _ = store
    out = str(tmp_path / "g")
    files.write_graph(s.nodes, s.edges, out)
    nodes, edges = files.read_graph(spark, out)
    assert collect(nodes, "name") == collect(s.nodes, "name") and edges.count() == 4
    assert files.read_graph(spark, str(tmp_path / "none"))[0].count() == 0
    assert files.read_table(spark, str(tmp_path / "none"), schemas.FILE_LOG).isEmpty()
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"A": {"name": "A", "node_type": "event", "source_tg": ["t"]}}, "edges": [{"source_id": "A", "target_id": "B", "edge_type": "causal"}], "metadata": {}}))
    nodes, edges = files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert collect(nodes, "name") == [("A",)] and collect(edges, "src", "dst", "confidence", "ord") == [("A", "B", 1.0, 0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "BATCH-0001.json").write_text('{"id":"BATCH-0001","qa_pairs":[{"question":"q"}]}')
    (tmp_path / "b" / "BATCH-0002.json").write_text("broken")
    assert collect(files.read_batches(spark, str(tmp_path / "b")).where("id is not null"), "id") == [("BATCH-0001",)]
    np.savez(tmp_path / "v.npz", node_ids=np.array(["a"], object), embeddings=np.ones((1, 3), np.float32))
    assert files.read_npz(spark, str(tmp_path / "v.npz")).first().v == [1.0, 1.0, 1.0]
    codes = spark.createDataFrame([("t", "graph TD", None)], "tg_id string, flowchart string, sequence string")
    files.write_diagrams(codes, str(tmp_path / "m"))
    assert collect(spark.read.parquet(str(tmp_path / "m")), "tg_id", "kind") == [("t", "flowchart")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "TG-1_flowchart.mmd").write_text("graph TD")
    assert collect(files.read_diagrams(spark, str(tmp_path / "d"))) == [("TG-1", "flowchart", "graph TD")]


def test_streaming_ingests_each_file_once(spark, folder, tmp_path):
    args = (spark, folder, str(tmp_path / "out"), str(tmp_path / "ck"), Splitter("paragraph"))
    for _ in range(2):
        ingest.ingest(*args).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("id").distinct().count() == 6


def test_providers():
    e = providers.HashEmbedding(16)
    v = e.embed(["pump", "pump", ""])
    assert np.allclose(v[0], v[1]) and v.shape == (3, 16)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429")
        return "ok"

    clock = [0.0]
    limiter = providers.RateLimiter(2, 5.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert providers.call_with_retry(flaky, 5, 1.0, limiter, lambda s: None) == "ok" and clock[0] > 3
    with pytest.raises(providers.EmptyResponse):
        providers.call_with_retry(lambda: " ", 2, 0.0, sleep=lambda s: None)
    assert providers.is_rate_limit(RuntimeError("rate_limit hit")) and not providers.is_rate_limit(None)
    assert providers.safe_content({"a": [{"b": "x"}]}, "a", 0, "b") == "x" and providers.safe_content({}, "a", 0) == ""
    assert not providers.finished("length") and providers.finished("stop")
    c = providers.CallableEmbedding(lambda t: [[float(len(x)), 0.0] for x in t], 2, batch=2, query_prefix="q: ")
    assert c.embed(["a", "bb", "ccc"])[:, 0].tolist() == [1, 2, 3] and c.embed_query("a")[0] == 4


class Policy:
    """Answers by the node that a prompt shows."""

    def __init__(self, said):
        self.said = said

    def complete(self, prompt):
        node = prompt.split("<node>\n")[1].split("\n")[0]
        out = self.said.get(node, "{}")
        if out == "fail":
            raise RuntimeError("no answer")
        return out


def walk(spark, said, strategy, hops=6, tokens=5000):
    """A walk from a over a -> b, a -> c, b -> d, c -> e; every node has one chunk."""
    emb = providers.HashEmbedding(16)
    names = [(n,) for n in "abcde"]
    nodes = spark.createDataFrame([(n, "event", ["T"], {}) for (n,) in names], "name string, node_type string, source_tg array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "e", 0)], "src string, dst string, ord long")
    vec = spark.createDataFrame([(n, emb.embed([n])[0].tolist()) for (n,) in names], "name string, v array<double>")
    chunks = spark.createDataFrame([(f"k{n}", f"text of {n}") for (n,) in names], "id string, text string")
    chunk_vec = spark.createDataFrame([(f"k{n}", emb.embed([f"text of {n}"])[0].tolist()) for (n,) in names], "id string, v array<double>")
    mounts = spark.createDataFrame([(n, f"k{n}", 1) for (n,) in names], "name string, chunk_id string, rank int")
    store = Store(nodes, edges, vec, chunks, chunk_vec, mounts, spark.createDataFrame([], "chunk_id string, keyword string"), spark.createDataFrame([], "keyword string, v array<double>"))
    config = RetrievalConfig(anchors=1, hops=hops, strategy=strategy, context_tokens=tokens)
    r = Retriever(store, emb, config, policy=Policy(said) if said is not None else None)
    r.anchors = lambda asked, k: asked.select("query_id", F.lit("a").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    out = r.walk(r.questions(spark.createDataFrame([("q", "Which text is it?")], "query_id string, question string")))
    return out["paths"].first().path, sorted(x.id for x in out["knowledge"].collect()), out["enough"].count()


def test_policy_chooses_the_next_node(spark):
    said = {"a": 'I go on. {"next_nodes": ["[c]"]}', "c": '{"sufficient": false, "next_nodes": ["zz", "e"]}', "e": '{"sufficient": true}'}
    assert walk(spark, said, "full_context") == (list("ace"), ["ka", "kc", "ke"], 1)


def test_full_context_leaves_the_anchor_where_a_call_fails(spark):
    assert walk(spark, {"a": '{"next_nodes": ["b"]}', "b": "fail"}, "full_context") == (list("ab"), ["ka", "kb"], 0)


def test_step_by_step_goes_back_to_open_branches(spark):
    assert walk(spark, {"a": "fail"}, "step_by_step")[0] == list("abdce")  # first successors, then the branch passed over
    assert walk(spark, {"a": '{"next_nodes": ["c"]}'}, "step_by_step")[0] == list("acebd")
    assert set(walk(spark, None, "step_by_step")[0]) == set("abcde")


def test_incremental_build_equals_the_whole_build(spark, tmp_path, collect):
    for k, v in TEXTS.items():
        (tmp_path / f"{k}.txt").write_text(v)
    emb = providers.HashEmbedding()
    all_files = files.read_texts(spark, str(tmp_path))
    whole, _ = build(all_files, emb, generate)
    one, outcome = build(all_files.where("tg_id = 'TG-1'"), emb, generate)
    log = outcome.select(F.concat("item", F.lit(".txt")).alias("source_file"), "success")
    two, _ = build(all_files, emb, generate, log=log, into=one)
    assert collect(two.nodes, "name", "node_type", "source_tg") == collect(whole.nodes, "name", "node_type", "source_tg")
    assert collect(two.edges, "src", "dst") == collect(whole.edges, "src", "dst")
    assert collect(two.chunks, "id", "text") == collect(whole.chunks, "id", "text")
    assert collect(two.mounts, "name", "chunk_id") == collect(whole.mounts, "name", "chunk_id")
    assert collect(two.chunk_kw, "chunk_id", "keyword") == collect(whole.chunk_kw, "chunk_id", "keyword")
    a, b = ({r.name: r.v for r in x.node_vec.collect()} for x in (two, whole))
    assert a.keys() == b.keys() and all(np.allclose(a[n], b[n], atol=1e-6) for n in a)
