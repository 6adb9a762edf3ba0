import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from procgraph import providers
from procgraph.operators import report
from procgraph.plans import generate

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Canned(providers.LanguageModel):
    def complete(self, prompt):
        if "boom" in prompt:
            raise RuntimeError("429")
        if prompt.startswith(generate.DIAGRAM_PROMPT):
            return '{"keywords": ["pump"], "mermaid_code": "flowchart TD\\nA[x] --> B[y]"}' if "good" in prompt else "nothing"
        if prompt.startswith(generate.GRAPH_PROMPT):
            return '{"nodes": [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}], "edges": [{"source": 1, "target": 2}]}' if "good" in prompt else "flowchart TD\nC[c] --> D[d]"
        if prompt.startswith(generate.DEVICE_PROMPT):
            return 'It is {"system_device": "pump"}' if "pump" in prompt else "?"
        return '[{"question": "q", "answer": "a", "category": "Cat_2_Graph_Better"}]'


def test_generation(spark, collect):
    docs = spark.createDataFrame([("g", "good"), ("b", "bad"), ("x", "boom"), ("n", None)], "id string, text string")
    out = {r.id: (r.success, r.error_message) for r in generate.diagrams(docs, "id", "text", Canned()).collect()}
    assert out["g"] == (True, None) and out["b"] == (False, "no valid diagram") and out["x"][1].endswith("429") and not out["n"][0]
    nodes, edges = generate.graph(docs.where("id in ('g', 'b')"), "id", "text", Canned())
    assert collect(nodes, "name") == [("A",), ("B",), ("c",), ("d",)] and collect(edges, "src", "dst") == [("A", "B"), ("c", "d")]
    qa = generate.questions(docs.where("id = 'g'").union(docs.where("id = 'g'")), "id", "text", Canned())
    assert collect(qa, "question_type") == [("procedural",)]


def test_devices_and_boost(spark, collect):
    asked = spark.createDataFrame([("1", "the pump?"), ("2", "what?")], "query_id string, question string")
    dev = generate.devices(asked, Canned())
    assert collect(dev, "query_id", "system_device") == [("1", "pump"), ("2", "")]
    cand = spark.createDataFrame([("1", "n"), ("1", "m"), ("2", "n")], "query_id string, id string")
    kw = spark.createDataFrame([("n", ["pump"]), ("m", [])], "id string, keywords array<string>")
    assert collect(generate.keyword_boost(dev, cand, kw, providers.HashEmbedding())) == [("1", "n", 1.0)]


def test_reports(spark, collect, tmp_path):
    rows = spark.createDataFrame([("q", "a", "x", 1.0, "graph"), ("q", "b", None, 2.0, "vector")], "query_id string, id string, text string, score double, source_type string")
    assert collect(report.numbered_context(rows, 5))[0][1] == "[1] (vector) \n[2] (graph) x"
    paths = spark.createDataFrame([("q", 2, ["c", "a"]), ("q", 1, ["a", "b"])], "query_id string, anchor int, path array<string>")
    assert collect(report.step_order(paths)) == [("q", "a → b → c")]
    assert collect(report.extractor_statistics(rows, 4)) == [(4, 2, 0.5)] and collect(report.extractor_statistics(rows, 0))[0][2] == 0.0
    reached = spark.createDataFrame([("s", "y", 2), ("s", "x", 1)], "start string, name string, hop int")
    assert collect(report.by_hop(reached), "name", "place") == [("x", 1), ("y", 2)]
    assert report.without_vectors(rows.withColumn("v", F.array())).columns == rows.columns
    report.replace_table(rows, str(tmp_path / "t"))
    report.clear_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
    assert report.checked_namespace("工艺_1") == "工艺_1"
    try:
        report.checked_namespace("a-b")
        raise AssertionError
    except ValueError:
        pass
