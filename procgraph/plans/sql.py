"""SQL that the queries of plans.queries are checked against."""

STRIP = r"regexp_replace({0}, '^[\s\x0B\p{{Z}}\x{{0085}}]+|[\s\x0B\p{{Z}}\x{{0085}}]+$', '', 'g')"


def strip(c: str) -> str:
    return STRIP.format(c)


_VECTORS = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(q.q, CAST(e.embedding AS DOUBLE[])), 6) AS score
      FROM q JOIN embeddings e ON true),
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s),
f AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
      FROM {source})
SELECT query_id, id, score, rank FROM f WHERE {where}
"""

_SOUND = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

_EDGES = """
e AS (SELECT src, dst, CAST(min(ord) AS BIGINT) AS ord
      FROM (SELECT name AS src, unnest(successors) AS dst, unnest(range(len(successors))) AS ord
            FROM graph_nodes WHERE name IS NOT NULL)
      WHERE dst IS NOT NULL GROUP BY ALL)"""

_EVENTS = """
ev AS (SELECT user_id || ':' || event_type AS src,
              lead(user_id || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_id AS ord
       FROM events),
e AS (SELECT src, dst, min(ord) AS ord FROM ev WHERE dst IS NOT NULL GROUP BY ALL)"""

_RINGS = """
step AS (SELECT DISTINCT a, b FROM ({steps})),
r AS (SELECT DISTINCT {start} AS start, {start} AS name, 0 AS hop FROM {starts}
      UNION
      SELECT r.start, step.b, r.hop + 1 FROM r JOIN step ON r.name = step.a WHERE r.hop < {hops})
SELECT start, name, min(hop) AS hop FROM r GROUP BY ALL HAVING min(hop) > 0
"""

_PATHS = """
p AS (SELECT DISTINCT {start} AS name, [{start}] AS path, CAST([] AS BIGINT[]) AS ords FROM {starts}
      UNION ALL
      SELECT p.name, list_append(p.path, e.{to}), list_append(p.ords, e.ord)
      FROM p JOIN e ON p.path[-1] = e.{frm}
      WHERE NOT list_contains(p.path, e.{to}) AND len(p.path) <= {most}),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len(path) DESC, ords, path) AS n FROM p)
"""

_RANKED = """
{name} AS (SELECT * FROM (
  SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
  FROM (SELECT query_id, id, round(max({score}) FILTER (NOT isnan({score})), 9) AS score FROM retrieval_results
        WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL)
  WHERE score IS NOT NULL) WHERE rank <= {keep})"""


def ranked(name: str, score: str, keep: int) -> str:
    return _RANKED.format(name=name, score=score, keep=keep)


_CHUNKS = """
c AS (SELECT id, arg_max(text, {t: ingested_at, x: coalesce(text, '')}) AS text FROM text_chunks WHERE id IS NOT NULL GROUP BY id)"""

_CHUNKS_EXACT = """
c AS (SELECT id, text FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST) AS n
      FROM text_chunks WHERE id IS NOT NULL) WHERE n = 1)"""

_KW = f"""
k AS (SELECT DISTINCT {strip('keyword')} AS keyword, chunk_id
      FROM (SELECT keyword, unnest(chunk_ids) AS chunk_id FROM keyword_entries)
      WHERE {strip('keyword')} <> '' AND chunk_id IS NOT NULL)"""

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[\\s\\x0B，。！？；：、（）【】《》\"]+'), lambda x: x <> '')"
_LONG = "list_filter(" + _TOKENS + ", lambda x: length(x) >= 2)"

_PROXY = (
    "CAST(floor((CASE WHEN " + strip("text") + " = '' THEN 0 ELSE len(regexp_split_to_array(" + strip("text")
    + r", '[\s\x0B\p{Z}\x{0085}]+')) END) * 1.15::DOUBLE) AS BIGINT)"
)
_BUDGET = (
    "WITH " + ranked("q", "vector_score", 10**9) + "," + _CHUNKS_EXACT
    + f", b AS (SELECT q.query_id, q.id, q.score, q.rank, {_PROXY} AS tokens FROM q JOIN c USING (id) WHERE c.text IS NOT NULL)"
)

_TITLE = strip("regexp_replace(split_part(text, chr(10), 1), '^#+\\s*', '')")
_TITLED = f"""
t AS (SELECT doc_id AS key, {_TITLE} AS title, length(text) AS length FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, CASE WHEN instr(title, ' - ') > 0 THEN {strip("left(title, instr(title, ' - ') - 1)")} ELSE title END AS product FROM t)"""

_LOG = "log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS n FROM {0}) WHERE n = 1)"
_HASH = "md5(replace(" + strip("question") + ", chr(13) || chr(10), chr(10)))"
_FAKE = (
    "(status = 'success' AND (" + strip("coalesce(answer, '')")
    + " IN ('无法回答', '无法生成答案', '', '根据当前可用数据，无法找到与该问题直接相关的信息。')"
    + " OR regexp_matches(" + strip("coalesce(answer, '')") + ", '^(生成答案时出错:|无法生成答案：|假成功-|无法回答：)')"
    + " OR contains(coalesce(answer, ''), 'I am sorry but I am unable to answer')))"
)

_RESIDUAL = (
    "WITH RECURSIVE " + _EDGES + f""",
base AS (SELECT name, max(embedding) AS v FROM graph_nodes WHERE name IS NOT NULL AND {_SOUND} GROUP BY name),
step AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT DISTINCT name AS start, name, 0 AS hop FROM base
      UNION SELECT r.start, step.b, r.hop + 1 FROM r JOIN step ON r.name = step.a WHERE r.hop < 2),
ring AS (SELECT start, name, min(hop) AS hop FROM r GROUP BY ALL HAVING min(hop) > 0),
x AS (SELECT name, unnest(v)::DOUBLE AS x, unnest(range(64)) AS pos FROM base),
m AS (SELECT ring.start AS name, ring.hop, x.pos, avg(x.x) AS x FROM ring JOIN x ON ring.name = x.name GROUP BY ALL),
g AS (SELECT name, pos, sum(x * pow(0.5, hop)) AS x FROM m GROUP BY ALL),
h AS (SELECT x.name, x.pos, x.x + coalesce(g.x, 0) AS x FROM x LEFT JOIN g USING (name, pos))
SELECT name, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 6) AS x FROM h
"""
)

SQL = {
    "vector_topk": _VECTORS.format(source="s", where="rank <= 10"),
    "vector_filter_topk": _VECTORS.format(source="s WHERE label = 3", where="rank <= 10"),
    "vector_overfetch_filter": _VECTORS.format(source="a WHERE rank <= 50 AND label = 3", where="rank <= 10"),
    "keyword_threshold": _VECTORS.format(source="s", where="rank <= 10 AND score >= 0.3"),
    "similarity_topk_join": f"""
WITH n AS (SELECT name, source_tg, embedding FROM (
       SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_tg DESC NULLS LAST, embedding DESC) AS k
       FROM graph_nodes WHERE name IS NOT NULL AND {_SOUND}) WHERE k = 1),
c AS (SELECT id, tg_id, embedding FROM (
       SELECT *, row_number() OVER (PARTITION BY id ORDER BY tg_id DESC NULLS LAST, embedding DESC) AS k
       FROM text_chunks WHERE id IS NOT NULL AND {_SOUND}) WHERE k = 1),
p AS (SELECT n.name, c.id AS chunk_id,
             max(round(list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)) AS score
      FROM (SELECT name, unnest(list_distinct(source_tg)) AS tg, embedding FROM n) n JOIN c ON n.tg = c.tg_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, chunk_id) AS INT) AS rank FROM p)
SELECT * FROM r WHERE rank <= 5""",
    "mount_stats": """
WITH m AS (SELECT DISTINCT name, unnest(enrichment_chunks) AS chunk_id FROM graph_nodes)
SELECT (SELECT count(DISTINCT name) FROM graph_nodes) AS n_nodes, count(DISTINCT name) AS n_mounted, count(*) AS n_mounts FROM m""",
    "node_context": "WITH " + _CHUNKS_EXACT + """,
m AS (SELECT name, chunk_id, min(pos) AS pos FROM (
        SELECT name, unnest(enrichment_chunks) AS chunk_id, unnest(range(len(enrichment_chunks))) AS pos FROM graph_nodes)
      WHERE chunk_id IS NOT NULL GROUP BY ALL),
t AS (SELECT m.name, string_agg(CASE WHEN length(c.text) > 300 THEN left(c.text, 300) || '...' ELSE c.text END, ' | ' ORDER BY m.pos, c.id) AS text
      FROM m JOIN c ON m.chunk_id = c.id WHERE c.text IS NOT NULL GROUP BY m.name)
SELECT n.name, '【事件】' || n.name || CASE WHEN t.text <> '' THEN chr(10) || '【相关知识】' || t.text ELSE '' END AS context
FROM (SELECT DISTINCT name FROM graph_nodes) n LEFT JOIN t USING (name)""",
    "bm25_topk": f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents),
p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(len(t)) FROM d)::DOUBLE / count(*) AS avgdl FROM documents),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, n GROUP BY term, n),
w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf
      FROM (SELECT item_id AS query_id, unnest({_TOKENS.format('question')}) AS term FROM eval_items) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(qtf * (idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), n GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s WHERE score > 0)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10""",
    "inverted_index": "WITH " + _KW + " SELECT keyword, count(*) AS frequency, string_agg(chunk_id, '|' ORDER BY chunk_id) AS chunk_ids FROM k GROUP BY keyword",
    "keyword_stats": "WITH " + _KW + """
SELECT count(DISTINCT keyword) AS n_keywords, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_pairs,
       round(count(*) / count(DISTINCT keyword), 2) AS chunks_per_keyword,
       round(count(*) / count(DISTINCT chunk_id), 2) AS keywords_per_chunk FROM k""",
    "keyword_lookup": "WITH " + _KW + f"""
SELECT DISTINCT k.keyword, k.chunk_id FROM k
WHERE keyword IN (SELECT {strip('keyword')} FROM keyword_entries
                  WHERE TRY_CAST(regexp_extract(entry_key, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)""",
    "new_chunks": "WITH " + _KW + " SELECT DISTINCT id AS chunk_id FROM text_chunks WHERE id IS NOT NULL AND id NOT IN (SELECT chunk_id FROM k)",
    "entity_retrieval": "WITH " + _KW + "," + _CHUNKS_EXACT + f""",
q AS (SELECT id AS query_id, min(question) AS question FROM qa_pairs WHERE question IS NOT NULL GROUP BY id),
w AS (SELECT query_id, word, min(pos) AS pos FROM (
        SELECT query_id, unnest({_LONG.format('question')}) AS word, unnest(range(len({_LONG.format('question')}))) AS pos FROM q) GROUP BY ALL),
z AS (SELECT keyword, count(*) AS n FROM k GROUP BY keyword),
y AS (SELECT DISTINCT keyword, n, unnest({_LONG.format('keyword')}) AS word FROM z),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n, keyword) AS rank FROM y) WHERE rank <= 5),
m AS (SELECT query_id, chunk_id AS id, arg_min(s.keyword, {{a: w.pos, b: s.rank, c: s.keyword}}) AS matched_keyword
      FROM w JOIN s USING (word) JOIN k ON k.keyword = s.keyword GROUP BY ALL),
f AS (SELECT m.*, len(list_intersect(list_distinct({_TOKENS.format('c.text')}), list_distinct({_TOKENS.format('q.question')})))::DOUBLE AS score
      FROM m JOIN c USING (id) JOIN q USING (query_id) WHERE c.text IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f)
SELECT query_id, id, matched_keyword, score, rank FROM r WHERE rank <= 10""",
    "position_weight": """
SELECT entry_key, batch, round(1 - 0.1::DOUBLE * (row_number() OVER (PARTITION BY entry_key ORDER BY batch NULLS FIRST) - 1), 6) AS weight
FROM (SELECT DISTINCT entry_key, batch FROM keyword_entries)""",
    "rrf_two_way": "WITH " + ranked("v", "vector_score", 30) + "," + ranked("b", "bm25_score", 30) + """,
f AS (SELECT query_id, id, round(coalesce(0.6::DOUBLE / (60 + v.rank), 0) + coalesce(0.4::DOUBLE / (60 + b.rank), 0), 9) AS score
      FROM v FULL JOIN b USING (query_id, id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f)
SELECT * FROM r WHERE rank <= 10""",
    "rrf_multi_signal": "WITH " + ranked("v", "vector_score", 30) + "," + ranked("b", "bm25_score", 30) + "," + ranked("s", "score", 30) + """,
f AS (SELECT query_id, id, v.rank AS vector_rank, b.rank AS bm25_rank,
             round(coalesce(1::DOUBLE / (60 + v.rank), 0) + coalesce(1::DOUBLE / (60 + b.rank), 0), 9) AS rrf_score
      FROM v FULL JOIN b USING (query_id, id)),
g AS (SELECT f.*, coalesce(round(1::DOUBLE / s.rank, 9), 0) AS keyword_boost FROM f LEFT JOIN s USING (query_id, id)),
h AS (SELECT *, round(rrf_score + 0.1::DOUBLE * keyword_boost, 9) AS score FROM g),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM h)
SELECT * FROM r WHERE rank <= 10""",
    "rank_interleave": "WITH " + ranked("v", "vector_score", 10) + "," + ranked("b", "bm25_score", 10) + """,
a AS (SELECT query_id, id, rank, 0 AS src FROM v UNION ALL SELECT query_id, id, rank, 1 FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, src) AS n FROM a)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, src) AS INT) AS place FROM o WHERE n = 1""",
    "paragraph_chunks": f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(
             CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END,
             lambda x: {strip('x')}), lambda x: length(x) >= 10) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(len(c))) AS INT) AS chunk_index, unnest(c) AS chunk FROM p""",
    "chunk_ids": """
SELECT DISTINCT source_file, chunk_index, replace(source_file, '.', '_') || '_' || chunk_index || '_' ||
       left(md5(source_file || '_' || chunk_index), 8) AS chunk_id
FROM text_chunks WHERE chunk_index IS NOT NULL""",
    "fixed_window_chunks": f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(range(1, greatest(length(text), 1) + 1, 450),
             lambda i: {strip('substring(text, i, 500)')}), lambda x: x <> '') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(len(c))) AS INT) AS chunk_index, unnest(c) AS chunk FROM w""",
    "graph_merge": """
WITH o AS (SELECT *, {a: coalesce(node_type, ''), b: to_json(source_tg)::VARCHAR} AS o FROM graph_nodes),
f AS (SELECT name, arg_min_null(node_type, o) AS node_type FROM o GROUP BY name),
t AS (SELECT name, tg, min({o: o, p: p}) AS at FROM (
        SELECT name, o, unnest(source_tg) AS tg, unnest(range(len(source_tg))) AS p FROM o) WHERE tg IS NOT NULL GROUP BY ALL)
SELECT f.name, f.node_type, coalesce(string_agg(t.tg, '|' ORDER BY t.at), '') AS source_tg
FROM f LEFT JOIN t USING (name) GROUP BY ALL""",
    "node_upsert": """
SELECT name, node_type, n_chunks FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_chunks DESC, node_type DESC NULLS LAST) AS k
  FROM (SELECT DISTINCT name, node_type, coalesce(len(enrichment_chunks), 0) AS n_chunks FROM graph_nodes)) WHERE k = 1""",
    "edge_dedup": "WITH " + _EVENTS + " SELECT * FROM e",
    "neighbours": "WITH " + _EVENTS + " SELECT src AS name, dst AS neighbour FROM e UNION SELECT dst, src FROM e",
    "adjacent_edges": "WITH " + _EDGES + """
SELECT dst AS name, src AS neighbour, 'next' AS edge_type, '' AS relation_name, '' AS condition
FROM e WHERE src IN (SELECT name FROM graph_nodes)""",
    "adjacency": "WITH " + _EVENTS + """,
s AS (SELECT src AS name, string_agg(dst, '|' ORDER BY ord, dst) AS successors FROM e GROUP BY src),
p AS (SELECT dst AS name, string_agg(src, '|' ORDER BY ord, src) AS predecessors FROM e GROUP BY dst)
SELECT * FROM s FULL JOIN p USING (name)""",
    "khop_bfs": "WITH RECURSIVE " + _EVENTS + "," + _RINGS.format(
        steps="SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e", start="a", starts="step", hops=3),
    "bfs_forward": "WITH RECURSIVE " + _EDGES + "," + _RINGS.format(
        steps="SELECT src AS a, dst AS b FROM e", start="name", starts="graph_nodes", hops=5),
    "causal_chain": "WITH RECURSIVE " + _EVENTS + "," + _PATHS.format(start="src", starts="e", to="dst", frm="src", most=4)
    + "SELECT name, array_to_string(path, ' > ') AS path FROM b WHERE n = 1",
    "node_chains": "WITH RECURSIVE " + _EDGES + "," + _PATHS.format(start="name", starts="graph_nodes", to="src", frm="dst", most=5)
    + "SELECT name, array_to_string(path, ' > ') AS path FROM b WHERE n = 1",
    "expand_results": "WITH " + _EDGES + "," + ranked("q", "vector_score", 50) + """,
f AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM q
      WHERE id IN (SELECT name FROM graph_nodes)) WHERE n <= 3),
nb AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
g AS (SELECT f.query_id, nb.b AS id, max(f.score) * 0.7::DOUBLE AS score FROM f JOIN nb ON f.id = nb.a
      WHERE (f.query_id, nb.b) NOT IN (SELECT (query_id, id) FROM f) GROUP BY ALL),
z AS (SELECT query_id, count(*) AS n FROM f GROUP BY 1),
h AS (SELECT query_id, id, score FROM (SELECT g.*, z.n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k
      FROM g JOIN z USING (query_id)) WHERE k <= 5 - n),
a AS (SELECT query_id, id, score, 0 AS hop FROM f UNION ALL SELECT query_id, id, score, 1 FROM h)
SELECT query_id, id, round(score, 9) AS score, hop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM a""",
    "residual_embedding": _RESIDUAL,
    "graph_stats": "WITH " + _EDGES + """
SELECT 'type:' || coalesce(node_type, '?') AS measure, count(*) AS value FROM graph_nodes GROUP BY 1
UNION ALL SELECT 'nodes', count(*) FROM graph_nodes
UNION ALL SELECT 'edges', count(*) FROM e
UNION ALL SELECT 'with_vector', count(*) FILTER (len(embedding) > 0) FROM graph_nodes""",
    "budget_prefix": _BUDGET + """,
u AS (SELECT *, CAST(sum(tokens) OVER w + 6 * (count(*) OVER w - 1) AS BIGINT) AS used FROM b
      WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT query_id, id, score, tokens, used FROM u WHERE used <= 700""",
    "budget_supplement": _BUDGET + """,
u AS (SELECT *, CAST(900 - coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS l
      FROM b WHERE tokens >= 60)
SELECT query_id, id, score, tokens, least(tokens, l) AS taken, tokens > l AS cut FROM u WHERE l > 0 AND (tokens <= l OR l >= 50)""",
    "budget_two_tier": _BUDGET + """,
x AS (SELECT *, CASE WHEN starts_with(id, 'BATCH') THEN 0 ELSE 1 END AS tier FROM b),
w AS (SELECT *, sum(tokens) OVER t AS total, count(*) OVER t AS n FROM x
      WINDOW t AS (PARTITION BY query_id, tier ORDER BY rank ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, total + 6 * (n - 1) AS used, 700 AS lim FROM w WHERE tier = 0),
zf AS (SELECT *, used <= lim AS fits, lim - (used - tokens) AS l, coalesce(lag(used <= lim) OVER (PARTITION BY query_id ORDER BY rank), true) AS prev FROM z),
zt AS (SELECT *, CASE WHEN fits THEN tokens ELSE l END AS taken, CASE WHEN fits THEN used ELSE lim END AS after
       FROM zf WHERE fits OR (prev AND l > 30)),
s AS (SELECT query_id, max(after) AS spent FROM zt GROUP BY 1),
o AS (SELECT w.*, coalesce(s.spent, 0) + total + 6 * (n - CASE WHEN s.spent IS NULL THEN 1 ELSE 0 END) AS used, 1000 AS lim
      FROM w LEFT JOIN s USING (query_id) WHERE tier = 1),
of AS (SELECT *, used <= lim AS fits, lim - (used - tokens) AS l, coalesce(lag(used <= lim) OVER (PARTITION BY query_id ORDER BY rank), true) AS prev FROM o),
ot AS (SELECT *, CASE WHEN fits THEN tokens ELSE l END AS taken FROM of WHERE fits OR (prev AND l > 30))
SELECT query_id, id, score, tokens, tier, CAST(taken AS BIGINT) AS taken, NOT fits AS cut FROM zt
UNION ALL SELECT query_id, id, score, tokens, tier, CAST(taken AS BIGINT), NOT fits FROM ot""",
    "causal_context": "WITH RECURSIVE " + _EDGES + "," + ranked("q", "vector_score", 50) + """,
f AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM q
      WHERE id IN (SELECT name FROM graph_nodes)) WHERE n <= 3),""" + _PATHS.format(start="id", starts="f", to="dst", frm="src", most=5).replace("p AS", "pf AS").replace("FROM p JOIN", "FROM pf JOIN").replace("p.", "pf.").replace("FROM p)", "FROM pf)").replace("b AS", "bf AS") + "," + _PATHS.format(start="id", starts="f", to="src", frm="dst", most=5) + """
SELECT f.query_id, f.id, f.id
       || CASE WHEN len(b.path) > 1 THEN ' | 原因链: ' || array_to_string(list_reverse(b.path[2:]), ' → ') ELSE '' END
       || CASE WHEN len(bf.path) > 1 THEN ' | 后果链: ' || array_to_string(bf.path[2:], ' → ') ELSE '' END AS text,
       CAST(len(bf.path) AS INT) AS forward_length, CAST(len(b.path) AS INT) AS backward_length
FROM f JOIN b ON b.name = f.id AND b.n = 1 JOIN bf ON bf.name = f.id AND bf.n = 1""",
    "question_type": """
SELECT CASE WHEN regexp_matches(question, '步骤|流程|怎么做|如何操作|操作方法|怎样进行|怎么进行|执行顺序|操作顺序|程序|需要经过|需要哪些步骤|如何执行|怎么执行') THEN 'procedural'
            WHEN regexp_matches(question, '如果|若|什么情况下|什么条件|不满足|异常时|故障时|区别|不同') THEN 'conditional'
            WHEN regexp_matches(question, '为什么|原因|导致|造成|引起|后果|为何|怎么会') THEN 'causal' ELSE 'factual' END AS kind, count(*) AS n
FROM (SELECT question FROM retrieval_records UNION ALL SELECT question FROM qa_pairs) WHERE question IS NOT NULL GROUP BY 1""",
    "question_hash": f"SELECT {_HASH} AS question_hash, min({strip('question')}) AS question FROM retrieval_records WHERE question IS NOT NULL GROUP BY 1",
    "question_antijoin": f"""
WITH a AS (SELECT {_HASH} AS h, min({strip('question')}) AS question FROM retrieval_records WHERE question IS NOT NULL GROUP BY 1),
l AS (SELECT h, status, answer FROM (SELECT *, {_HASH} AS h,
        row_number() OVER (PARTITION BY {_HASH} ORDER BY retrieval_time DESC NULLS LAST, record_id DESC NULLS LAST) AS n
        FROM retrieval_records WHERE question IS NOT NULL) WHERE n = 1)
SELECT question FROM a WHERE h NOT IN (SELECT h FROM l WHERE NOT (coalesce(status = 'error', false) OR coalesce({_FAKE}, false)))""",
    "question_stats": "WITH " + _LOG.format("retrieval_records") + """
SELECT count(*) AS n_questions, count(*) FILTER (status = 'success') AS n_success,
       count(*) FILTER (status IS DISTINCT FROM 'success') AS n_failed, CAST(coalesce(sum(token_usage), 0) AS BIGINT) AS total_tokens,
       round(coalesce(avg(token_usage) FILTER (status = 'success'), 0), 6) AS avg_tokens FROM log""",
    "failed_stats": "WITH " + _LOG.format("retrieval_records") + f"""
SELECT CASE WHEN status IS DISTINCT FROM 'success' AND regexp_matches(lower(coalesce(error, '')), '429|rate_limit|rate limit') THEN '429'
            WHEN status IS DISTINCT FROM 'success' AND contains(lower(coalesce(error, '')), 'timeout') THEN 'timeout'
            WHEN {_FAKE} THEN 'fake_success' WHEN status IS DISTINCT FROM 'success' THEN 'other' END AS error_class, count(*) AS n
FROM log GROUP BY 1 HAVING error_class IS NOT NULL""",
    "failed_questions": "SELECT DISTINCT question, error FROM retrieval_records WHERE status IS DISTINCT FROM 'success' AND contains(coalesce(error, ''), 'timeout')",
    "file_antijoin": "SELECT DISTINCT tg_id FROM documents WHERE tg_id IS NOT NULL AND tg_id NOT IN (SELECT tg_id FROM file_records WHERE success AND tg_id IS NOT NULL)",
    "build_stats": "WITH " + _LOG.format("file_records") + """
SELECT count(*) AS n_files, count(*) FILTER (success) AS n_success, count(*) FILTER (success IS DISTINCT FROM true) AS n_failed,
       CAST(coalesce(sum(nodes_count) FILTER (success), 0) AS BIGINT) AS n_nodes,
       CAST(coalesce(sum(edges_count) FILTER (success), 0) AS BIGINT) AS n_edges FROM log""",
    "token_cost": "WITH " + _LOG.format("retrieval_records") + """
SELECT category, CAST(sum(token_usage) AS BIGINT) AS tokens,
       round(CAST(sum(token_usage) AS DOUBLE) / 1e6 * CASE category WHEN 'prompt' THEN 0.8::DOUBLE ELSE 2.0::DOUBLE END, 9) AS cost
FROM (SELECT CASE WHEN status = 'success' THEN 'prompt' ELSE 'completion' END AS category, token_usage FROM log WHERE token_usage IS NOT NULL)
GROUP BY 1""",
    "content_hash": """
WITH o AS (SELECT DISTINCT coalesce(tg_id, '?') AS tg_id, sha256(text) AS h FROM text_chunks WHERE text IS NOT NULL),
p AS (SELECT tg_id, left(h, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM o GROUP BY ALL)
SELECT tg_id, CAST(sum(n) AS BIGINT) AS n_items, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM p GROUP BY tg_id""",
    "format_tokens": "WITH " + _LOG.format("retrieval_records") + """,
s AS (SELECT status, sum(token_usage)::BIGINT AS n FROM log GROUP BY status)
SELECT status, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN printf('%.2fK', n / 1000) ELSE printf('%.2fM', n / 1000000) END AS shown FROM s""",
    "exact_dedup": "WITH " + _TITLED + """
SELECT key, product, title, CAST(length AS INT) AS length FROM (
  SELECT *, row_number() OVER (PARTITION BY product, title ORDER BY length DESC, key) AS n FROM u) WHERE n = 1""",
    "renumber": """
SELECT source_file, row_number() OVER (ORDER BY source_file) AS number,
       printf('BATCH-%04d', row_number() OVER (ORDER BY source_file)) AS new_name
FROM (SELECT DISTINCT source_file FROM text_chunks WHERE source_file IS NOT NULL)""",
    "qa_first_wins": f"""
SELECT id, question FROM (SELECT id, {strip('question')} AS question, row_number() OVER (PARTITION BY {strip('question')} ORDER BY id) AS n
                          FROM qa_pairs WHERE {strip('question')} <> '') WHERE n = 1""",
    "qa_stats": f"""
SELECT coalesce(question_type, 'unknown') AS question_type, coalesce(lower({strip('difficulty')}), 'unknown') AS difficulty, count(*) AS n
FROM (SELECT id, any_value(question_type) AS question_type, any_value(difficulty) AS difficulty FROM qa_pairs GROUP BY id) GROUP BY ALL""",
    "mermaid_nodes": """
SELECT * FROM (VALUES ('TG-1', 'A', '检查阀门', 'event', 0), ('TG-1', 'B', '压力正常?', 'condition', 1), ('TG-1', 'C', '启动泵', 'event', 2),
  ('TG-1', 'D', '停机', 'condition', 3), ('TG-1', 'E', '记录', 'event', 4), ('TG-1', 'F', '结束', 'event', 5), ('TG-1', 'G', '归档', 'event', 6))
  t(tg_id, id, text, node_type, ord)""",
    "mermaid_edges": """
SELECT * FROM (VALUES ('TG-1', 'A', 'B', '', '-->', 0), ('TG-1', 'B', 'C', '是', '-->', 1), ('TG-1', 'B', 'D', '否', '-->', 2),
  ('TG-1', 'C', 'E', '', '-.->', 3), ('TG-1', 'C', 'F', '', '-->', 4), ('TG-1', 'D', 'F', '', '-->', 5), ('TG-1', 'F', 'G', '', '-->', 6))
  t(tg_id, source_id, target_id, label, edge_style, ord)""",
    "mermaid_sequence": """
SELECT * FROM (VALUES ('TG-1', '操作员', '泵', '启动', 'sync', 0), ('TG-1', '泵', '操作员', '就绪', 'async', 1),
  ('TG-1', '操作员', '泵', '启动', 'sync', 2)) t(tg_id, sender, receiver, message, message_type, ord)""",
    "qa_flatten": """
SELECT * FROM (VALUES ('BATCH-0001', 0, 'q1', 'How?', 'Slowly', 'unknown', 0, true, 'pump'),
  ('BATCH-0001', 2, 'q2', 'Why?', '', 'hard', 2, false, ''))
  t(source_batch, pos, id, question, answer, difficulty, expected_hops, requires_graph_reasoning, keywords)""",
}
