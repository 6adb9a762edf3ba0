import numpy as np
from difflib import SequenceMatcher
import random
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procgraph.functions.text import proxy_tokens
from procgraph.operators import budget, caches, curation, fusion, graph, lexical, mount, node_embed, parsing, search

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("e", "x"), ("f", "f"), ("a", "b")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(EDGES)], "src string, dst string, ord long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n,) for n in "abcdefg"], "name string")


def test_edges_first_and_last_win(edges, collect):
    assert len(collect(graph.dedup_edges(edges))) == 8
    assert ("a", "b", 0) in collect(graph.dedup_edges(edges)) and ("a", "b", 8) in collect(graph.last_edge(edges))


def test_rings(spark, edges, nodes, collect):
    got = collect(graph.rings(edges, nodes.where("name in ('a', 'f', 'g')"), 4, "forward"), "start", "name", "hop")
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "e", 2), ("a", "x", 3)]
    both = collect(graph.rings(edges, spark.createDataFrame([("x",)], "name string"), 2), "name", "hop")
    assert both == [("b", 2), ("d", 2), ("e", 1)]
    assert graph.rings(edges.where("false"), nodes, 2).count() == 0


def test_longest_paths(edges, nodes, collect):
    first = graph.dedup_edges(edges)
    got = dict(collect(graph.longest_paths(first, nodes, "forward", 5).select("name", F.array_join("path", ""))))
    assert got == {"a": "abex", "b": "bcadex", "c": "cabex", "d": "dex", "e": "ex", "f": "f", "g": "g"}
    # A diamond: the path along the earlier edges wins.
    assert dict(collect(graph.longest_paths(first, nodes, "forward", 2).select("name", F.array_join("path", ""))))["a"] == "abc"
    with pytest.raises(ValueError):
        graph.directed(edges, "up")


def test_merge_upsert_adjacency(spark, collect):
    rows = [("n", "event", {"k": "1"}, ["t1", "t2"], 0), ("n", "condition", None, ["t2", "t3", None], 1), ("m", None, None, None, 2)]
    df = spark.createDataFrame(rows, "name string, node_type string, properties map<string,string>, source_tg array<string>, o int")
    got = {r.name: (r.node_type, r.source_tg) for r in graph.merge_nodes(df, "o").collect()}
    assert got == {"n": ("event", ["t1", "t2", "t3"]), "m": (None, [])}
    assert collect(graph.upsert_nodes(df, "o"), "name", "o") == [("m", 2), ("n", 1)]
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 0)], "src string, dst string, ord long")
    got = {r.name: (r.successors, r.predecessors) for r in graph.adjacency(e).collect()}
    assert got == {"a": (["c", "b"], None), "b": (None, ["a"]), "c": (None, ["a"])}
    ids = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert collect(graph.resolve_edges(e, ids), "src", "dst") == [("A", "B")]


def test_adjacent_edges_and_expansion(spark, edges, nodes, collect):
    full = edges.withColumns({"edge_type": F.lit("causal"), "relation_name": F.lit(None).cast("string"), "properties": F.create_map(F.lit("condition"), F.lit("hot"))})
    got = collect(graph.adjacent_edges(full, nodes).where("name = 'e' or name = 'd'"))
    assert got == [("d", "e", "causal", "", "hot")]  # e -> x dangles
    results = spark.createDataFrame([("q", "a", 1.0), ("q", "d", 0.5)], "query_id string, id string, score double")
    got = collect(graph.expand_results(results, edges, 4), "id", "score", "rank")
    assert got == [("a", 1.0, 1), ("b", 0.7, 2), ("c", 0.7, 3), ("d", 0.5, 4)]
    assert graph.expand_results(results, edges, 2).count() == 2  # Q-01
    assert graph.expand_results(results, edges, 1, always=True).count() == 3


def test_causal_context(spark, edges, collect):
    first = graph.dedup_edges(edges)
    found = spark.createDataFrame([("q", "e", "text of e")], "query_id string, id string, text string")
    starts = found.select(F.col("id").alias("name"))
    f, b = graph.longest_paths(first, starts, "forward"), graph.longest_paths(first, starts, "backward")
    text, n, m = collect(graph.causal_context(found, f, b), "text", "forward_length", "backward_length")[0]
    assert text == "text of e | 原因链: b → c → a → d | 后果链: x" and (n, m) == (2, 5)
    assert "原因链: e → d → a → c" in collect(graph.causal_context(found, f, b, compat=True), "text")[0][0]  # Q-02


def test_residual_vectors(spark, collect):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-4.0, 0.0])], "name string, v array<double>")
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 1)], "src string, dst string, ord long")
    got = {r.name: r.v for r in node_embed.residual_vectors(base, e, 0.5, 2).collect()}
    h = (1 + 0.25 * -4, 0.5 * 2)  # the sum is (0, 1)
    assert got["a"] == pytest.approx([h[0] / math.hypot(*h), h[1] / math.hypot(*h)])
    assert all(math.hypot(*v) == pytest.approx(1) for v in got.values())
    for bad in ({"gamma": 0}, {"hops": 0}):
        with pytest.raises(ValueError):
            node_embed.residual_vectors(base, e, **{"gamma": 0.5, "hops": 1, **bad})
    # An update gives what a full run gives (Q-11).
    old = node_embed.residual_vectors(base.where("name <> 'c'"), e.where("src = 'a'"), 0.5, 2)
    new = {r.name: r.v for r in node_embed.embed_new_nodes(old, base, e, 0.5, 2).collect()}
    assert {k: pytest.approx(v) for k, v in new.items()} == got
    text = {r.name: r.context for r in node_embed.context_text(base, e).collect()}
    assert text == {"a": "before: b", "b": "after: a; before: c", "c": "after: b"}


def test_vector_search(spark, collect):
    items = [(1, [1.0, 0.0], {"s": "x"}), (2, [1.0, 0.0], {"s": "y"}), (3, [0.0, 1.0], None), (4, [0.0, 0.0], {}), (5, None, {}), (6, [1.0], {})]
    df = spark.createDataFrame([(*r, 0.0) for r in items], "id int, v array<float>, md map<string,string>, score double")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, q array<float>")
    assert collect(search.search(q, df, 2)) == [("q", 1, 1.0, 1), ("q", 2, 1.0, 2)]  # ties by id, zero query empty
    only_y = search.match_metadata("md", {"s": "y"})
    assert collect(search.search(q, df, 1, where=only_y), "id") == [(2,)]
    assert search.search(q, df, 1, where=only_y, overfetch=1).count() == 0
    assert collect(search.search(q, df, 9, least=0.5), "id") == [(1,), (2,)]
    assert search.search(q.where("false"), df, 2).count() == 0 and search.search(q, df.where("false"), 2).count() == 0


def test_bm25(spark, collect):
    docs = [(1, "valve pump"), (2, "valve valve motor"), (3, "valve"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "id int, text string")
    posted = lexical.postings(df, "id", F.col("text"))
    q = spark.createDataFrame([("q", "Pump, valve valve")], "query_id string, text string")
    q2 = spark.createDataFrame([("q", "pump valve valve")], "query_id string, text string")
    n, avg = 5, 6 / 5
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in (("valve", 3), ("pump", 1), ("motor", 1))}
    mean = sum(raw.values()) / 3
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: part("pump", 1, 2) + 2 * part("valve", 1, 2), 2: 2 * part("valve", 2, 3), 3: 2 * part("valve", 1, 1)}
    got = dict(collect(lexical.bm25(q2, posted, n), "id", "score"))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert 1 in dict(collect(lexical.bm25(q, posted, n), "id", "score"))  # "pump," is another token


def test_keywords(spark, collect):
    kw = spark.createDataFrame([("c1", " pump "), ("c1", "pump"), ("c2", "pump"), ("c2", " "), (None, "x"), ("c3", None)], "chunk_id string, keyword string")
    assert collect(lexical.inverted_index(kw)) == [("pump", 2, ["c1", "c2"])]
    assert collect(lexical.keyword_statistics(kw.where("false")))[0][3:] == (0.0, 0.0)
    vec = {"p": [1.0, 0.0], "q": [0.99, 0.1], "r": [0.0, 1.0]}
    rows = [("d", w, i, rel, vec[w]) for i, (w, rel) in enumerate((("p", 0.9), ("q", 0.89), ("r", 0.5)))]
    df = spark.createDataFrame(rows, "id string, word string, ord int, relevance double, v array<double>")
    assert [r.word for r in sorted(lexical.mmr(df, 2, 0.7).collect(), key=lambda r: r.pos)] == ["p", "r"]
    assert [r.word for r in sorted(lexical.max_sum(df, 2).collect(), key=lambda r: r.pos)] == ["p", "q"]
    docs = spark.createDataFrame([(1, "pump valve pump motor pump"), (2, ""), (3, None)], "id int, text string")
    ranks = {r.word: r.score for r in lexical.text_rank(docs, "id", F.col("text")).collect()}
    assert max(ranks, key=ranks.get) == "pump" and len(ranks) == 3


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(range(6)))
def test_fusion_ignores_row_order(spark, order):
    a = [("q", f"i{k}", k + 1) for k in range(4)]
    b = [("q", f"i{k}", n + 1) for n, k in enumerate((3, 5, 0))]
    mixed = [x for _, x in sorted(zip(order, a + [("q", "z", 9), ("q", "y", 8)]))]
    frame = lambda r: spark.createDataFrame(r, "query_id string, id string, rank int")
    out = fusion.reciprocal_rank_fusion([(frame(mixed), 0.6), (frame(b), 0.4)], 3).collect()
    got = [(r.id, r.rank) for r in sorted(out, key=lambda r: r.rank)]
    assert got == [("i0", 1), ("i3", 2), ("i1", 3)]


def test_interleave_and_first_wins(spark, collect):
    frame = lambda r: spark.createDataFrame(r, "query_id string, id string, score double")
    g, v = frame([("q", "a", 9.0), ("q", "b", 8.0), ("q", "c", 7.0)]), frame([("q", "b", 0.9), ("q", "d", 0.1)])
    got = [r.id for r in sorted(fusion.interleave(g, v).collect(), key=lambda r: r.place)]
    assert got == ["a", "b", "d", "c"]
    assert ("q", "b", 8.0) in collect(fusion.first_wins([g, v], ["query_id", "id"]))
    assert ("q", "b", 0.9) in collect(fusion.latest_wins(g, v, ["query_id", "id"]))
    assert collect(fusion.unseen(g, v, ["query_id", "id"]), "id") == [("a",), ("c",)]


def greedy(tokens, limit, sep):
    used, out = 0, []
    for i, t in enumerate(tokens):
        cost = t + (sep if out else 0)
        if used + cost > limit:
            break
        used += cost
        out.append(i)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), max_size=15), st.integers(0, 150))
def test_prefix_budget_is_greedy(spark, tokens, limit):
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(tokens)], "q string, i int, t int")
    got = sorted(r.i for r in budget.prefix(df, ["q"], [F.col("i")], "t", limit).collect())
    assert got == greedy(tokens, limit, 6)


def test_supplement_and_two_tier(spark, collect):
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate([300, 99, 120, 400, 10])], "q string, i int, t int")
    take = lambda n: collect(budget.supplement(df, ["q"], [F.col("i")], "t", n), "i", "taken", "cut")
    assert take(350) == [(0, 300, False), (2, 50, True)] and take(349) == [(0, 300, False)]
    rows = [("q", 0, 0, 500), ("q", 0, 1, 400), ("q", 0, 2, 50), ("q", 1, 0, 200), ("q", 1, 1, 300)]
    df = spark.createDataFrame(rows, "q string, tier int, i int, t int")
    got = collect(budget.two_tier(df, ["q"], [F.col("i")], "t", 1000), "tier", "i", "taken", "cut")
    assert got == [(0, 0, 500, False), (0, 1, 194, True), (1, 0, 200, False)]
    assert budget.anchor_budget(7000, 0, 2) == 4900 and budget.anchor_budget(1000, 900, 1) == 1000
    room = spark.createDataFrame([(0, False), (6900, False), (10, True)], "u int, s boolean")
    assert [r[0] for r in room.select(budget.supplement_budget(7000, F.col("u"), F.col("s"))).collect()] == [2450, 0, 1400]


def test_mounting(spark, collect, monkeypatch):
    monkeypatch.setattr(mount, "SIDE_BLOCK", 2)
    nodes = spark.createDataFrame([("n1", "t", [1.0, 0.0]), ("n2", "t", [0.0, 1.0]), ("n3", "u", [1.0, 0.0]), ("n1", "u", [1.0, 0.0])], "name string, tg string, v array<float>")
    chunks = spark.createDataFrame([(f"c{k}", "t", [1.0, k / 5]) for k in range(7)] + [("d", "u", [0.5, 0.5]), ("e", "w", [1.0, 0.0])], "chunk_id string, tg string, v array<float>")
    got = collect(mount.similarity_top_k(nodes, chunks, 2, 2), "name", "rank", "chunk_id")
    assert got == [("n1", 1, "c0"), ("n1", 2, "c1"), ("n2", 1, "c6"), ("n2", 2, "c5"), ("n3", 1, "d")]
    mounts = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("n", "gone", 3)], "name string, chunk_id string, rank int")
    texts = spark.createDataFrame([("a", "x" * 310), ("b", "short")], "id string, text string")
    joined = mount.enrichment_text(mounts, texts)
    assert collect(joined)[0][1] == "x" * 300 + "... | short"
    assert mount.enrichment_text(mounts, texts, k=1).first().text == "x" * 300 + "..."
    who = spark.createDataFrame([("n",), ("m",)], "name string")
    assert dict(collect(mount.node_context(who, joined)))["m"] == "【事件】m"


def test_logs(spark, collect):
    rows = [
        (1, "Q1 ", "a", "success", None, 1), (2, "Q2", "无法回答", "success", None, 1), (3, "Q3", None, "error", "429", 1), (4, "Q4", "x", "error", "timeout", 1),
        (5, "Q4", "fine", "success", None, 2), (6, None, "x", "success", None, 2),
    ]
    log = spark.createDataFrame(rows, "record_id long, question string, answer string, status string, error string, t int")
    log = log.withColumn("retrieval_time", F.timestamp_seconds("t")).withColumn("token_usage", F.lit(10))
    asked = spark.createDataFrame([(q,) for q in ("Q1", "Q2", "Q3", "Q4", "Q5", "Q5")], "question string")
    assert collect(caches.questions_to_process(asked, log), "question") == [("Q2",), ("Q3",), ("Q5",), ("Q5",)]
    assert collect(caches.questions_to_process(asked, log, retry=False), "question") == [("Q5",), ("Q5",)]
    assert dict(collect(caches.failures(log))) == {"fake_success": 1, "429": 1, "timeout": 1}
    assert collect(caches.question_statistics(log.where("false"))) == [(0, 0, 0, 0, 0.0)]
    assert collect(caches.failed_questions(log, "time"), "question") == [("Q4",)]
    usage = spark.createDataFrame([("prompt", "r1", 1_000_000), ("prompt", "r2", 500_000), ("other", "r1", 7)], "category string, run_id string, tokens long")
    assert dict((r[0], r[2]) for r in collect(caches.token_cost(usage))) == {"prompt": 1.2, "other": 0.0}
    assert ("prompt", 1_500_000, 500_000) in collect(caches.token_totals(usage, "r2"))
    flags = spark.createDataFrame([("kw", False, 1)], "stage string, done boolean, updated_at int")
    assert collect(caches.upsert_flags(flags, spark.createDataFrame([("kw", True, 2)], flags.schema))) == [("kw", True, 2)]
    a = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "x"), ("g", None)], "g string, t string")
    b = spark.createDataFrame([("g", "y"), ("g", "x")], "g string, t string")
    assert collect(caches.fingerprint(a, "g", "t")) == collect(caches.fingerprint(b, "g", "t"))
    assert caches.all_done(asked.where("false"), log, "question") and not caches.all_done(asked, log.select("question"), "question")


def sequential(docs, threshold):
    from difflib import SequenceMatcher

    kept = []
    for k, p, proc, n in sorted(docs, key=lambda d: (-d[3], d[0])):
        if not any(p == q and SequenceMatcher(None, proc, x).ratio() > threshold for _, q, x, _ in kept):
            kept.append((k, p, proc, n))
    return sorted(kept)


def test_fuzzy_dedup_equals_the_sequential_rule(spark, collect, monkeypatch):
    import random

    monkeypatch.setattr(curation, "ROUND_TITLES", 4)
    rng = random.Random(1)
    docs = [(k, f"P{k % 2}", "".join(rng.choice("abc") for _ in range(rng.randrange(4))) + rng.choice(["start the pump", "stop the motor", "clean", ""]), rng.randrange(50)) for k in range(60)]
    df = spark.createDataFrame(docs, "key long, product string, procedure string, length int")
    assert collect(curation.fuzzy_dedup(df, 0.8)) == sequential(docs, 0.8)
    assert curation.fuzzy_dedup(df.where("false")).count() == 0
    texts = spark.createDataFrame([(1, "# P - start\nlong body"), (2, "# P - start\nx"), (3, "# P - stop it all\nx"), (4, None)], "id long, text string")
    flags = collect(curation.dedup_flags(curation.titled(texts, "id", "text")), "key", "kept")
    assert flags == [(1, True), (2, False), (3, True)]


def test_renumber_and_questions(spark, collect):
    df = spark.createDataFrame([(f"f{k:03d}",) for k in range(50)], "f string").repartition(7)
    got = collect(curation.renumber(df, "f", start=5), "f", "new_name")
    assert got == [(f"f{k:03d}", f"BATCH-{k + 5:04d}") for k in range(50)]
    assert curation.renumber(df.where("false"), "f").count() == 0
    qa = spark.createDataFrame([("1", " q ", None, " Hard"), ("2", "q", "x", "hard"), ("3", " ", "x", None), ("4", None, "x", None)], "id string, question string, question_type string, difficulty string")
    assert collect(curation.first_questions(qa, ["id"]), "id", "question") == [("1", "q")]
    assert collect(curation.qa_statistics(qa)) == [("unknown", "hard", 1), ("x", "hard", 1), ("x", "unknown", 2)]


def test_parsing_operators(spark, collect):
    content = '```json\n{"nodes":[{"id":"1","name":"A","type":"设备"},{"id":"2","name":"B"}],"edges":[{"source":"1","target":"2","relation":"触发"}]}\n```'
    df = spark.createDataFrame([("t1", content), ("t2", None), ("t3", "junk")], "tg string, c string")
    nodes, edges = parsing.json_graph_rows(df, "tg", "c")
    assert collect(nodes, "name", "node_type") == [("A", "equipment"), ("B", "event")]
    assert collect(edges, "src", "dst", "edge_type") == [("A", "B", "triggers")]
    codes = spark.createDataFrame([("t", "graph TD\nA[泵] --> B[阀]", "sequenceDiagram\nO->>P: x")], "tg string, f string, s string")
    nodes, edges = parsing.graph_rows(codes, "tg", "f", "s")
    assert nodes.count() == 3 and collect(edges, "src", "dst", "source_tg") == [("泵", "阀", "t")]
    out = parsing.qa_rows(spark.createDataFrame([("d", '[{"question":"q","answer":"a","related_nodes":["n"]}]')], "doc string, r string"), "doc", "r")
    assert out.first().related_nodes == ["n"]
    assert parsing.keywords_and_codes(df, "tg", "c").count() == 3


def test_proxy_tokens(spark):
    df = spark.createDataFrame([("a b  c",), ("",), (None,), ("　",)], "t string")
    assert [r[0] for r in df.select(proxy_tokens(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_bm25_top_equals_the_join(spark, collect, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["泵", "über"]
    text = lambda n: " ".join(words[min(31, int(rng.expovariate(0.2)))] for _ in range(n))
    docs = [(k, text(rng.randrange(0, 40))) for k in range(300)] + [(900, None), (901, ""), (902, "w0 " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", text(5) + " w0") for k in range(25)] + [("none", "zz"), ("blank", None)], "query_id string, text string")
    scored = lexical.bm25(asked, lexical.postings(df, "doc_id", F.col("text")), df.count())
    want = search.top_k(scored.where("score > 0").withColumn("score", F.round("score", 6)), 7)
    cols = ("query_id", "id", "score", "rank")
    assert collect(lexical.bm25_top(asked, df, "doc_id", F.col("text"), 7), *cols) == collect(want, *cols)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 6)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 50)
    assert collect(lexical.bm25_top(asked, df, "doc_id", F.col("text"), 7), *cols) == collect(want, *cols)
    assert lexical.bm25_top(asked, df.where("false"), "doc_id", F.col("text"), 7).count() == 0
    assert lexical.bm25_top(asked.where("false"), df, "doc_id", F.col("text"), 7).count() == 0


def test_queries_beyond_one_broadcast(spark, collect, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(200)], "id long, v array<double>")
    asked = items.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = collect(search.search(asked, items, 3))
    monkeypatch.setattr(search, "MAX_QUERIES", 60)
    assert collect(search.search(asked, items, 3)) == want and len(want) == 600


def test_fuzzy_dedup_equals_the_greedy_rule(spark, collect, monkeypatch):
    rng = random.Random(3)
    words = "pump valve filter burner hoist 泵 阀 check clean restart isolate line shift slow ok".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) + str(rng.randrange(100)) * rng.randrange(2)
    rows = [(k, rng.choice(["A", "A", "B", None]), title(), rng.randrange(5)) for k in range(400)]
    rows += [(500, "A", None, 1)]
    df = spark.createDataFrame(rows, "key long, product string, procedure string, length int").where("procedure is not null")
    kept = {}
    for k, g, p, n in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[3], r[0])):
        if not any(SequenceMatcher(None, p, x).ratio() > 0.8 or p == x for _, x in kept.get(g, [])):
            kept.setdefault(g, []).append((k, p))
    want = sorted(k for v in kept.values() for k, _ in v)
    assert [r[0] for r in collect(curation.fuzzy_dedup(df), "key")] == want
    monkeypatch.setattr(curation, "ROUND_TITLES", 37)
    monkeypatch.setattr(curation, "MAX_KEPT", 5)
    assert [r[0] for r in collect(curation.fuzzy_dedup(df), "key")] == want
