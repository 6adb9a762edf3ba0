"""Queries over stored files and literal rows, for operators that no table of the
project exercises, with the results worked out by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import budget, caches, fusion, graph, lexical, mount, parsing, report
from ..session import checkpoint_folder, read
from ..sources import files
from . import queries as q
from .sql import _EDGES, _KW, _RINGS, _SOUND, ranked, strip


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/fixture-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: str) -> None:
    """A small file in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


# Functions of texts and vectors


def diagram_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "flowchart TD\nA[Start] --> B[End]"), (2, "todo"), (3, "flowchart TD"), (4, None), (5, "classDiagram without any link here"),
            (6, "Some text --> that is no diagram at all"), (7, "sequenceDiagram\nA->>B: hello")]
    return _rows(spark, rows, "id int, code string").select("id", text.valid_mermaid(F.col("code")).alias("valid"))


def chinese_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.contains_chinese(F.col("text")).alias("chinese"))


def last_characters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "text_chunks").where("text is not null").select("id", text.overlap_text(F.col("text"), 50).alias("tail"))


def collapsed_blanks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.collapse_blanks(F.col("text"))).alias("digest"))


def node_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = read(spark, d, "graph_nodes").select(text.node_type(F.col("node_type")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def edge_types(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "causal", "触发报警"), (2, "has_condition", "下一步"), (3, None, None), (4, "related", "影响"), (5, "weird", "x"), (6, " Triggers ", "then"), (7, "related", "x")]
    return _rows(spark, rows, "id int, kind string, relation string").select("id", text.edge_type(F.col("kind"), F.col("relation")).alias("edge_type"))


def cut_to_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "one two three four", 2), (2, "one two", 2), (3, "one two three", 0), (4, None, 3)]
    return _rows(spark, rows, "id int, t string, n int").select("id", text.truncate_to_tokens(F.col("t"), F.col("n")).alias("t"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, [1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0]), (2, [0.0] * 4, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 2.0, 2.0, 0.0], [2.0, 4.0, 4.0, 0.0]),
            (4, [1.0, 0.0], [1.0, 0.0, 0.0, 0.0]), (5, None, [1.0, 0.0, 0.0, 0.0]), (6, [3.0, 4.0, 0.0, 0.0], [-3.0, -4.0, 0.0, 0.0])]
    df = _rows(spark, rows, "id int, a array<double>, b array<double>")
    return df.select("id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    unit = read(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalized(F.col("embedding"))).alias("pos", "x"))
    return unit.withColumn("x", F.round("x", 6))


# Lists and budgets


def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "retrieval_results")
    kept = rows.where(fusion.source_floor(F.col("vector_score"), F.col("source_type")))
    return kept.groupBy("source_type").agg(F.count("*").alias("n"))


def _two_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    return [q._ranked(spark, d, c, q.K).select("query_id", "id", "score") for c in ("vector_score", "bm25_score")]


def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_wins(_two_lists(spark, d), ["query_id", "id"])


def union_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return fusion.latest_wins(*_two_lists(spark, d), ["query_id", "id"])


def union_unseen(spark: SparkSession, d: str) -> DataFrame:
    return fusion.unseen(*_two_lists(spark, d), ["query_id", "id"])


def hop_order(spark: SparkSession, d: str) -> DataFrame:
    reached = graph.rings(q._edges(spark, d), q._nodes(spark, d).select("name"), 2, "forward")
    return report.by_hop(reached).select("start", "name", "hop", "place")


def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    rows = [("q1", "a", "graph", 0.5, "first"), ("q1", "b", "vector", 0.9, "second"), ("q1", "c", "graph", 0.5, None), ("q2", "a", "graph", 0.1, "only")]
    return report.numbered_context(_rows(spark, rows, "query_id string, id string, source_type string, score double, text string"), 3)


def step_order(spark: SparkSession, d: str) -> DataFrame:
    rows = [("q1", 2, ["b", "c", "a"]), ("q1", 1, ["a", "b"]), ("q2", 1, ["x"])]
    return report.step_order(_rows(spark, rows, "query_id string, anchor int, path array<string>"))


def rows_without_vectors(spark: SparkSession, d: str) -> DataFrame:
    return report.without_vectors(read(spark, d, "embeddings"))


def plain_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", 1, 50), ("a", 2, 50), ("a", 3, 100), ("a", 4, 1), ("b", 1, 201), ("b", 2, 1), ("c", 1, 200), ("c", 2, 0)]
    return budget.prefix(_rows(spark, rows, "g string, o int, tokens int"), ["g"], [F.col("o")], "tokens", 200, 0)


def supplement_room(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, 0, False), (2, 1500, False), (3, 1850, False), (4, 100, True), (5, 0, True), (6, 1700, True)]
    df = _rows(spark, rows, "id int, used int, enough boolean")
    return df.select("id", budget.supplement_budget(2000, F.col("used"), F.col("enough")).alias("room"))


def new_mounts(spark: SparkSession, d: str) -> DataFrame:
    """Mounts of nodes whose enrichment text is missing."""
    return mount.new_mounts(q._mounts(spark, d), q._nodes(spark, d).where("enrichment_text is not null")).select("name", "chunk_id", "rank")


# Keywords


def known_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of chunks and whether an entry has a sound vector for them."""
    e = mount.sound(read(spark, d, "keyword_entries"), "entry_key", q.DIM, "keyword")
    vec = e.select(text.strip(F.col("keyword")).alias("keyword"), "v").groupBy("keyword").agg(F.max("v").alias("v"))
    return lexical.split_known(q._chunk_keywords(spark, d).select("keyword").distinct(), vec).select("keyword", "known")


def extractor_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.extractor_statistics(q._chunk_keywords(spark, d), read(spark, d, "text_chunks").select("id").distinct().count())


def top_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = [("t", "c", 2, 0.5), ("t", "a", 0, 0.5), ("t", "b", 1, 0.9), ("u", "z", 0, 0.1)]
    return lexical.max_sum(_rows(spark, rows, "id string, word string, ord int, relevance double"), 2)


def mmr_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = [("t", "same", 1, 0.8, [1.0, 0.0]), ("t", "best", 0, 0.9, [1.0, 0.0]), ("t", "other", 2, 0.7, [0.0, 1.0])]
    out = lexical.mmr(_rows(spark, rows, "id string, word string, ord int, relevance double, v array<double>"), 2)
    return out.select("id", "word", "pos")


def text_ranks(spark: SparkSession, d: str) -> DataFrame:
    out = lexical.text_rank(_rows(spark, [("1", "aa bb"), ("2", "cc"), ("3", None), ("4", "x")], "id string, t string"), "id", F.col("t"))
    return out.withColumn("score", F.round("score", 6))


# Logs


def stage_flags(spark: SparkSession, d: str) -> DataFrame:
    schema = "stage string, done boolean, updated_at string"
    return caches.upsert_flags(_rows(spark, [("a", False, "1"), ("b", True, "1")], schema), _rows(spark, [("a", True, "2"), ("c", False, "2")], schema))


def latest_answer(spark: SparkSession, d: str) -> DataFrame:
    return caches.latest_answers(read(spark, d, "retrieval_records")).select("question_hash", "record_id")


def token_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = [("prompt", "r1", 10), ("prompt", "r2", 5), ("embedding", "r1", 7), ("prompt", "r2", 1)]
    return caches.token_totals(_rows(spark, rows, "category string, run_id string, tokens long"), "r2")


# Parsers

TOLD = [
    ("1", "Here:\n```mermaid\nflowchart TD\nA --> B\n```\nand\n```\nsequenceDiagram\nA->>B: x\n```"),
    ("2", "flowchart TD\nA --> B\n总结 done\nC --> D"),
    ("3", "take `graph LR; A --> B` only"),
    ("4", "nothing"),
    ("5", None),
]
GRAPH_JSON = [
    ("T1", '<think>{"x"</think>```json\n{"entities":[{"id":"1","name":"A","type":"设备"},{"id":"2","name":"B"}],"relations":[{"source":"1","target":"2","relation":"触发"}]}\n```'),
    ("T2", 'Sure: {"nodes":[{"name":"C"},{"name":"D","type":"condition"}],"edges":[{"from":"C","to":"D","label":"then",},{"from":"C","to":"?"}],}'),
    ("T3", "no object"),
]


def diagram_extraction(spark: SparkSession, d: str) -> DataFrame:
    return parsing.extract_diagrams(_rows(spark, TOLD, "tg_id string, told string"), "tg_id", "told")


def keyword_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = [("1", '{"keywords": ["a", "b"], "mermaid_code": `graph TD`}'), ("2", '```json\n{"keywords": ["c"], "mermaid_code": "graph LR"}\n```'), ("3", "none")]
    out = parsing.keywords_and_codes(_rows(spark, rows, "tg_id string, told string"), "tg_id", "told")
    return out.select("tg_id", F.array_join("keywords", "|").alias("keywords"), "mermaid_code")


def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = parsing.json_graph_rows(_rows(spark, GRAPH_JSON, "tg_id string, told string"), "tg_id", "told")
    return nodes.select("name", "node_type", F.col("source_tg")[0].alias("tg"), "ord")


def json_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = parsing.json_graph_rows(_rows(spark, GRAPH_JSON, "tg_id string, told string"), "tg_id", "told")
    return edges.select("src", "dst", "edge_type", "relation_name", "source_tg")


def diagram_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = parsing.graph_rows(_rows(spark, [("TG-1", q.FLOW, q.SEQ)], "tg_id string, f string, s string"), "tg_id", "f", "s")
    return nodes.select("name", "node_type", "ord")


def diagram_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = parsing.graph_rows(_rows(spark, [("TG-1", q.FLOW, q.SEQ)], "tg_id string, f string, s string"), "tg_id", "f", "s")
    return edges.select("src", "dst", "edge_type", "relation_name")


def generated_pairs(spark: SparkSession, d: str) -> DataFrame:
    told = 'Pairs: [{"category": "Cat_1_All_Pass", "question": "Q1", "answer": "A1", "analysis": {"reason": "r", "evidence": "e"}}, {"question": "Q2", "answer": "A2", "question_type": "causal", "analysis": "why", "difficulty": "hard"}]'
    out = parsing.qa_rows(_rows(spark, [("D", told), ("E", "broken [")], "doc string, told string"), "doc", "told")
    return out.select("doc", "id", "question", "answer", "question_type", "difficulty", "need_text_knowledge", "evidence", "analysis")


# Stored files


def text_files(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    for name, content in (("TG-1.txt", "one\ntwo\n"), ("TG-2.new.txt", "泵"), ("other.md", "no"), ("TG-3.txt", "")):
        _put(spark, f"{at}/{name}", content)
    return files.read_texts(spark, at).where("file_size > 0").select("source_file", "tg_id", "text", "file_size")


def batch_files(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    _put(spark, f"{at}/BATCH-0001.json", q.BATCH)
    _put(spark, f"{at}/other.json", "{}")
    return files.read_batches(spark, at).select("id", "title", F.size("qa_pairs").alias("n_pairs"))


def diagram_files(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    _put(spark, f"{at}/TG-1_flowchart.mmd", "graph TD")
    _put(spark, f"{at}/TG-2_sequence.mmd", "sequenceDiagram")
    return files.read_diagrams(spark, at)


def stored_json(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    rows = read(spark, d, "qa_pairs").select("id", "question", "difficulty").distinct()
    files.write_json(rows, at)
    return spark.read.schema("id string, question string, difficulty string").json(at)


def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graph, written as tables, replaced, and read again."""
    at = _folder(spark)
    for _ in range(2):
        files.write_graph(q._nodes(spark, d).select("name", "node_type", "source_tg"), q._edges(spark, d), at)
    return files.read_graph(spark, at)[1].select("src", "dst", "ord")


def graph_json_file(spark: SparkSession, d: str) -> DataFrame:
    at = f"{_folder(spark)}/graph.json"
    _put(spark, at, '{"nodes": {"A": {"name": "A", "node_type": "event"}}, "edges": [{"source_id": "A", "target_id": "B", "edge_type": "causal", "relation_name": "then"},'
         ' {"source_id": "B", "target_id": "A", "edge_type": "triggers", "confidence": 0.5}], "metadata": {}}')  # fmt: skip
    return files.read_graph_json(spark, at)[1].select("src", "dst", "edge_type", "relation_name", "confidence", "ord")


def missing_table(spark: SparkSession, d: str) -> DataFrame:
    return files.read_table(spark, _folder(spark), "id string, n long")


QUERIES = {
    f.__name__: f
    for f in (
        diagram_validity, chinese_texts, last_characters, collapsed_blanks, node_types, edge_types, cut_to_tokens, cosine_pairs,
        unit_vectors, relevance_floor, union_first_wins, union_latest_wins, union_unseen, hop_order, numbered_context, step_order,
        rows_without_vectors, plain_prefix, supplement_room, new_mounts, known_keywords, extractor_stats, top_relevance, mmr_choice,
        text_ranks, stage_flags, latest_answer, token_runs, diagram_extraction, keyword_codes, json_nodes, json_edges, diagram_nodes,
        diagram_edges, generated_pairs, text_files, batch_files, diagram_files, stored_json, stored_graph, graph_json_file, missing_table,
    )
}


def _values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({names})"


_LISTS = "WITH " + ranked("v", "vector_score", 10) + "," + ranked("b", "bm25_score", 10)
_NL = "' || chr(10) || '"

SQL = {
    "diagram_validity": _values("id, valid", "1, true", "2, false", "3, false", "4, false", "5, false", "6, false", "7, true"),
    "chinese_texts": "SELECT doc_id, coalesce(regexp_matches(text, '[\\x{4e00}-\\x{9fff}]'), false) AS chinese FROM documents",
    "last_characters": "SELECT id, right(text, 50) AS tail FROM text_chunks WHERE text IS NOT NULL",
    "collapsed_blanks": "SELECT doc_id, md5(regexp_replace(text, ' {2,}', ' ', 'g')) AS digest FROM documents",
    "node_types": f"""
SELECT CASE WHEN k IN ('equipment', '设备') THEN 'equipment' WHEN k IN ('condition', '条件', '判断') THEN 'condition'
            WHEN k IN ('parameter', '参数') THEN 'parameter' WHEN k IN ('constraint', '约束') THEN 'constraint' ELSE 'event' END AS kind, count(*) AS n
FROM (SELECT lower({strip('node_type')}) AS k FROM graph_nodes) GROUP BY 1""",
    "edge_types": _values("id, edge_type", "1, 'triggers'", "2, 'has_condition'", "3, 'causal'", "4, 'causal'", "5, 'causal'", "6, 'triggers'", "7, 'related'"),
    "cut_to_tokens": _values("id, t", "1, 'one two...'", "2, 'one two'", "3, ''", "4, NULL"),
    "cosine_pairs": _values("id, similarity", "1, 0.707107::DOUBLE", "2, 0.0", "3, 1.0", "4, 0.0", "5, 0.0", "6, -1.0"),
    "unit_vectors": """
SELECT vec_id, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings)""",
    "relevance_floor": """
SELECT source_type, count(*) AS n FROM retrieval_results
WHERE vector_score IS NULL OR vector_score >= CASE WHEN source_type = 'vector_supplement' THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END GROUP BY 1""",
    "union_first_wins": _LISTS + """
SELECT query_id, id, score FROM v UNION ALL
SELECT query_id, id, score FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = b.query_id AND v.id = b.id)""",
    "union_latest_wins": _LISTS + """
SELECT query_id, id, score FROM b UNION ALL
SELECT query_id, id, score FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE v.query_id = b.query_id AND v.id = b.id)""",
    "union_unseen": _LISTS + """
SELECT query_id, id, score FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE v.query_id = b.query_id AND v.id = b.id)""",
    "hop_order": "WITH RECURSIVE " + _EDGES + "," + _RINGS.format(steps="SELECT src AS a, dst AS b FROM e", start="name", starts="graph_nodes WHERE name IS NOT NULL", hops=2)
    .replace("SELECT start, name, min(hop)", "SELECT start, name, min(hop) AS hop, CAST(row_number() OVER (PARTITION BY start ORDER BY min(hop), name) AS INT) AS place FROM r GROUP BY start, name HAVING min(hop) > 0 --"),
    "numbered_context": _values("query_id, context", f"'q1', '[1] (vector) second{_NL}[2] (graph) first{_NL}[3] (graph) '", "'q2', '[1] (graph) only'"),
    "step_order": _values("query_id, steps", "'q1', 'a → b → c'", "'q2', 'x'"),
    "rows_without_vectors": "SELECT vec_id, label FROM embeddings",
    "plain_prefix": _values("g, o, tokens, used", "'a', 1, 50, 50", "'a', 2, 50, 100", "'a', 3, 100, 200", "'c', 1, 200, 200", "'c', 2, 0, 200"),
    "supplement_room": _values("id, room", "1, 700", "2, 500", "3, 0", "4, 400", "5, 700", "6, 300"),
    "new_mounts": """
SELECT name, chunk_id, CAST(min(pos) AS INT) AS rank
FROM (SELECT name, unnest(enrichment_chunks) AS chunk_id, unnest(range(len(enrichment_chunks))) AS pos FROM graph_nodes)
WHERE chunk_id IS NOT NULL AND (name IS NULL OR name NOT IN (SELECT name FROM graph_nodes WHERE enrichment_text IS NOT NULL AND name IS NOT NULL)) GROUP BY ALL""",
    "known_keywords": "WITH " + _KW + f"""
SELECT DISTINCT keyword, keyword IN (SELECT {strip('keyword')} FROM keyword_entries WHERE entry_key IS NOT NULL AND keyword IS NOT NULL AND {_SOUND}) AS known FROM k""",
    "extractor_stats": "WITH " + _KW + """
SELECT t.n AS n_texts, k.n AS n_keywords, round(k.n / t.n, 6) AS keywords_per_text
FROM (SELECT count(*) AS n FROM k) k, (SELECT count(*) AS n FROM (SELECT DISTINCT id FROM text_chunks)) t""",
    "top_relevance": _values("id, word, pos, relevance", "'t', 'b', 0, 0.9::DOUBLE", "'t', 'a', 1, 0.5", "'u', 'z', 0, 0.1"),
    "mmr_choice": _values("id, word, pos", "'t', 'best', 0", "'t', 'other', 1"),
    "text_ranks": _values("id, word, score", "'1', 'aa', 1.0::DOUBLE", "'1', 'bb', 1.0", "'2', 'cc', 0.15"),
    "stage_flags": _values("stage, done, updated_at", "'a', true, '2'", "'b', true, '1'", "'c', false, '2'"),
    "latest_answer": f"""
SELECT question_hash, record_id FROM (
  SELECT md5(replace({strip('question')}, chr(13) || chr(10), chr(10))) AS question_hash, record_id,
         row_number() OVER (PARTITION BY md5(replace({strip('question')}, chr(13) || chr(10), chr(10)))
                            ORDER BY retrieval_time DESC NULLS LAST, record_id DESC NULLS LAST) AS n
  FROM retrieval_records WHERE question IS NOT NULL) WHERE n = 1""",
    "token_runs": _values("category, total, current", "'prompt', 16, 6", "'embedding', 7, 0"),
    "diagram_extraction": _values(
        "tg_id, flowchart, sequence", f"'1', 'flowchart TD{_NL}A --> B', 'sequenceDiagram{_NL}A->>B: x'", f"'2', 'flowchart TD{_NL}A --> B', NULL",
        "'3', 'graph LR; A --> B', NULL", "'4', NULL, NULL", "'5', NULL, NULL",
    ),
    "keyword_codes": _values("tg_id, keywords, mermaid_code", "'1', 'a|b', 'graph TD'", "'2', 'c', 'graph LR'", "'3', '', ''"),
    "json_nodes": _values("name, node_type, tg, ord", "'A', 'equipment', 'T1', 0", "'B', 'event', 'T1', 1", "'C', 'event', 'T2', 0", "'D', 'condition', 'T2', 1"),
    "json_edges": _values("src, dst, edge_type, relation_name, source_tg", "'A', 'B', 'triggers', '触发', 'T1'", "'C', 'D', 'causal', 'then', 'T2'"),
    "diagram_nodes": _values(
        "name, node_type, ord", "'检查阀门', 'event', 0", "'压力正常?', 'condition', 1", "'启动泵', 'event', 2", "'停机', 'condition', 3", "'记录', 'event', 4",
        "'结束', 'event', 5", "'归档', 'event', 6", "'操作员 -> 泵: 启动', 'event', 7", "'泵 -> 操作员: 就绪', 'event', 8",
    ),
    "diagram_edges": _values(
        "src, dst, edge_type, relation_name", "'检查阀门', '压力正常?', 'causal', ''", "'压力正常?', '启动泵', 'causal', '是'", "'压力正常?', '停机', 'causal', '否'",
        "'启动泵', '记录', 'triggers', ''", "'启动泵', '结束', 'causal', ''", "'停机', '结束', 'causal', ''", "'结束', '归档', 'causal', ''",
        "'操作员 -> 泵: 启动', '泵 -> 操作员: 就绪', 'causal', ''",
    ),
    "generated_pairs": _values(
        "doc, id, question, answer, question_type, difficulty, need_text_knowledge, evidence, analysis",
        "'D', 'D_factual_1', 'Q1', 'A1', 'factual', 'medium', true, 'e', 'r'", "'D', 'D_causal_2', 'Q2', 'A2', 'causal', 'hard', false, '', 'why'",
    ),
    "text_files": _values("source_file, tg_id, text, file_size", f"'TG-1.txt', 'TG-1', 'one{_NL}two{_NL}', 8", "'TG-2.new.txt', 'TG-2.new', '泵', 3"),
    "batch_files": _values("id, title, n_pairs", "'BATCH-0001', 'Pumps', 3"),
    "diagram_files": _values("tg_id, kind, code", "'TG-1', 'flowchart', 'graph TD'", "'TG-2', 'sequence', 'sequenceDiagram'"),
    "stored_json": "SELECT DISTINCT id, question, difficulty FROM qa_pairs",
    "stored_graph": "WITH " + _EDGES + " SELECT * FROM e",
    "graph_json_file": _values("src, dst, edge_type, relation_name, confidence, ord", "'A', 'B', 'causal', 'then', 1.0::DOUBLE, 0", "'B', 'A', 'triggers', NULL, 0.5, 1"),
    "missing_table": "SELECT '' AS id, 0::BIGINT AS n WHERE false",
}
