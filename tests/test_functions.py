import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procgraph.functions import splitters, text
from procgraph.functions import mermaid
from procgraph.functions.vectors import cosine, normalized


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "value, want",
    [("　x\n", "x"), (" a b ", "a b"), ("", ""), (None, None), ("\t\r\n ", "")],
)
def test_strip(spark, value, want):
    assert one(spark, value, text.strip) == want


def test_scalar_functions(spark):
    assert one(spark, "a.b.txt", lambda c: text.chunk_id(c, F.lit(3))) == "a_b_txt_3_" + hashlib.md5(b"a.b.txt_3").hexdigest()[:8]
    assert one(spark, " q\r\nr ", text.question_hash) == hashlib.md5(b"q\nr").hexdigest()
    assert one(spark, "x" * 301, text.cut) == "x" * 300 + "..." and one(spark, "x" * 300, text.cut) == "x" * 300
    assert one(spark, "a   b  c", text.collapse_blanks) == "a b c"
    assert [one(spark, n, text.format_token_count, "long") for n in (999, 1500, 2_000_000)] == ["999", "1.50K", "2.00M"]
    assert [one(spark, n, text.scaled_tokens, "long") for n in (0, 100, 101)] == [0, 114, 116]
    assert one(spark, "a b c d", lambda c: text.truncate_to_tokens(c, F.lit(2))) == "a b..."
    assert one(spark, "a b", lambda c: text.truncate_to_tokens(c, F.lit(2))) == "a b"
    assert one(spark, "abcdef", lambda c: text.overlap_text(c, 2)) == "ef"


@pytest.mark.parametrize(
    "q, kind",
    [("操作步骤是什么，为什么", "procedural"), ("如果压力高", "conditional"), ("为什么停机", "causal"), ("上限是多少", "factual"), ("", "factual")],
)
def test_question_type(spark, q, kind):
    assert one(spark, q, text.question_type) == kind
    assert one(spark, kind, text.answer_instructions).startswith("1. ")


def test_predicates(spark):
    good = "flowchart TD\nA[x] --> B[y]"
    assert [one(spark, v, text.valid_mermaid) for v in (good, "graph", "...", "hello world, this is text", None, "TODO")] == [True] + [False] * 5
    rows = [("success", "ok", None), ("success", " 无法回答 ", None), ("success", "无法生成答案：x", None), ("error", None, "429 rate"), ("error", None, "Timeout"), ("error", "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, a string, e string")
    got = df.select(text.error_class(F.col("s"), F.col("a"), F.col("e")), text.needs_retry(F.col("s"), F.col("a"))).collect()
    assert [r[0] for r in got] == [None, "fake_success", "fake_success", "429", "timeout", "other", "other"]
    assert [r[1] for r in got] == [False, True, True, True, True, True, False]
    assert one(spark, "泵a", text.contains_chinese) and not one(spark, None, text.contains_chinese)


def test_types_and_titles(spark):
    assert [one(spark, v, text.node_type) for v in ("设备", " Condition ", "?", None)] == ["equipment", "condition", "event", "event"]
    df = spark.createDataFrame([("related", "触发报警"), ("related", "x"), (None, "导致"), ("?", None)], "k string, r string")
    assert [r[0] for r in df.select(text.edge_type(F.col("k"), F.col("r"))).collect()] == ["triggers", "related", "causal", "causal"]
    df = spark.createDataFrame([("# Pump - start - now\nbody",), ("Pump",), ("",)], "t string")
    assert [tuple(r) for r in df.select(*text.product_and_procedure(F.col("t"))).collect()] == [("Pump", "start - now"), ("Pump", ""), ("", "")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(normalized(F.col("a"))).collect()][:2] == [[0.6, 0.8], [0.0, 0.0]]


PIECES = st.text(alphabet="ab。.\n #1", max_size=400)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(5, 60))
def test_packed_blocks_hold_all_characters(t, size):
    joined = "".join("".join(splitters.pack(t, size, 0)).split())
    kept = "".join(c for c in joined if c in "ab")
    assert kept == "".join(c for c in t if c in "ab")


def test_splitters():
    assert splitters.pack("aa\n\nbb\n\ncc", 6, 2) == ["aa\n\nbb", "bb\n\ncc"]
    assert splitters.pack("a" * 25, 10, 4) == ["a" * 10, "a" * 10, "a" * 10, "a" * 7, "a"]
    assert splitters.pack("one. two. three", 8, 0) == ["one. two", "three"]
    assert splitters.pack("  \n") == splitters.pack(None) == splitters.sections("") == splitters.sentences(None) == []
    assert splitters.sections("intro\n# A\nx\n# B\ny", 100, 0) == ["intro", "# A\nx", "# B\ny"]
    assert splitters.sentences("First one is here. Second is 3.5 long. Third!", 2, 5, 300) == ["First one is here.Second is 3.5 long.", "Third!"]
    # Q-13: a short chunk in the middle is dropped, a short last one joins.
    assert splitters.sentences("Long enough sentence. No. Another long sentence. Hm.", 1, 10, 300) == ["Long enough sentence.", "Another long sentence. Hm."]
    assert splitters.sentences("Long enough sentence. No. Another long sentence.", 1, 10, 300, True) == ["Long enough sentence. No.", "Another long sentence."]


def test_split_operator(spark, collect):
    df = spark.createDataFrame([(1, "para one is long\n\nshort\n\npara two is long", "x"), (2, None, "x"), (3, "", "x"), (4, "line number one\nline number two", "x")], "id int, text string, chunk string")
    got = collect(splitters.split(df, ["id"], "text", splitters.Splitter("paragraph")))
    assert got == [(1, 0, "para one is long"), (1, 1, "para two is long"), (4, 0, "line number one"), (4, 1, "line number two")]
    for kind in ("basic", "sentence", "semantic", "window"):
        out = splitters.split(df, ["id"], "text", splitters.Splitter(kind))
        assert out.columns == ["id", "chunk_index", "chunk"] and {r.id for r in out.collect()} == {1, 4}
        assert splitters.split(df.where("false"), ["id"], "text", splitters.Splitter(kind)).count() == 0
    with pytest.raises(ValueError):
        splitters.split(df, ["id"], "text", splitters.Splitter("?"))


FLOW = 'flowchart TD\n%% note\nA["检查"] --> B{"正常?"}\nB -->|是| C[启动]\nB -- 否 --> D{{停机}}\nC -.-> E\nC & D --> F[结束] --> G[归档]\ngraphics --> A'


def test_flowchart():
    d = mermaid.flowchart(FLOW)
    assert d.nodes["B"] == ("正常?", "condition") and d.nodes["E"] == ("E", "event")
    assert d.edges == [("A", "B", "", "-->"), ("B", "C", "是", "-->"), ("B", "D", "否", "-->"), ("C", "E", "", "-.->"), ("C", "F", "", "-->"),
                       ("D", "F", "", "-->"), ("F", "G", "", "-->"), ("graphics", "A", "", "-->")]
    assert ("F", "G", "", "-->") not in mermaid.flowchart(FLOW, compat=True).edges  # Q-08
    zh = mermaid.flowchart(FLOW, chinese_only=True)
    assert "E" not in zh.nodes and ("C", "E", "", "-.->") not in zh.edges
    assert mermaid.flowchart(None).nodes == {} and mermaid.flowchart("").edges == []


def test_sequence_and_graph():
    seq = "sequenceDiagram\nparticipant O as 操作员\nO->>P: 启动\nP-->>O: 就绪\nloop\nO->>P: 启动\nP->>O: 停"
    people, messages = mermaid.sequence(seq)
    assert people == {"O": "操作员", "P": "P"} and [m[3] for m in messages] == ["sync", "async", "sync", "sync"]
    nodes, edges = mermaid.graph_of(FLOW, seq, "TG-1")
    assert ("检查", "正常?", "causal", "") in edges
    # Q-17: the repeated message adds no edge but moves the pointer.
    assert edges[-2:] == [("操作员 -> P: 启动", "P -> 操作员: 就绪", "causal", ""), ("操作员 -> P: 启动", "P -> 操作员: 停", "causal", "")]
    assert len([n for n in nodes if n[0].startswith("操作员 -> P")]) == 1


def test_model_output():
    assert mermaid.json_of('text ```json\n{"a": 1}\n``` more') == {"a": 1} and mermaid.json_of("x {\"a\": {\"b\": 2}} y") == {"a": {"b": 2}}
    assert mermaid.json_of("nothing") is None and mermaid.repaired('{"a": [1,],} `') == '{"a": [1]}'
    assert mermaid.diagrams("```mermaid\ngraph TD\nA-->B\n```")["flowchart"] == "graph TD\nA-->B"
    assert mermaid.diagrams("flowchart TD\nA-->B\n# c\n分析\nx") == {"flowchart": "flowchart TD\nA-->B"}
    assert mermaid.keywords_and_code('{"keywords": ["a"], "mermaid_code": `graph TD\nA-->B`}') == (["a"], "graph TD\nA-->B")
    nodes, edges = mermaid.graph_of_json('<think>{}</think>{"nodes":[{"id":"1","name":"A"},{"id":"2","text":"B","type":"条件"}],"edges":[{"from":"1","to":"2"},{"from":"1","to":"9"}],}')
    assert [n[0] for n in nodes] == ["A", "B"] and edges == [("A", "B", "causal", "导致")]  # Q-06
    assert mermaid.graph_of_json("no json") is None
    rows = mermaid.qa_of('x [{"category":"Cat_1_All_Pass","question":"q","answer":"a","analysis":{"reason":"r","evidence":"e"}}, 5] y', "D")
    assert rows[0]["id"] == "D_factual_1" and rows[0]["evidence"] == "e" and len(rows) == 1 and mermaid.qa_of(None, "D") == []
