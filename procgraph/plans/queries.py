"""Queries over the project's tables, one or more per operator family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splitters, text
from ..operators import budget, caches, curation, fusion, graph, lexical, mount, node_embed, parsing, search
from ..providers import HashEmbedding
from ..session import broadcast_if_small, materialize, read
from .config import RetrievalConfig
from .retrieval import Retriever, Store

DIM, EVERY, K = 64, 50, 10


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "graph_nodes")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of_nodes(_nodes(spark, d))


def _event_edges(spark: SparkSession, d: str) -> DataFrame:
    """A denser graph: consecutive events of a user link (user, type) nodes."""
    node = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    following = F.lead(node).over(
        graph.Window.partitionBy("user_id").orderBy("ts", "event_id")
    )
    e = read(spark, d, "events").select(node.alias("src"), following.alias("dst"), F.col("event_id").alias("ord"))
    return graph.dedup_edges(e.where("dst is not null"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 50."""
    return _items(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


# Vector search


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_vector_queries(spark, d), _items(spark, d), K)


def vector_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_vector_queries(spark, d), _items(spark, d), K, where=F.col("label") == 3)


def vector_overfetch_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_vector_queries(spark, d), _items(spark, d), K, where=F.col("label") == 3, overfetch=5)


def keyword_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_vector_queries(spark, d), _items(spark, d), K, least=0.3)


def similarity_topk_join(spark: SparkSession, d: str) -> DataFrame:
    """Every node's 5 most similar chunks of its own documents."""
    nodes = mount.sound(_nodes(spark, d), "name", DIM, "source_tg").select("name", F.explode(F.array_distinct("source_tg")).alias("tg"), "v")
    chunks = mount.sound(read(spark, d, "text_chunks"), "id", DIM, "tg_id").select(F.col("id").alias("chunk_id"), F.col("tg_id").alias("tg"), "v")
    return mount.similarity_top_k(nodes, chunks, 5, DIM)


def mount_stats(spark: SparkSession, d: str) -> DataFrame:
    mounts = _nodes(spark, d).select("name", F.explode("enrichment_chunks").alias("chunk_id")).distinct()
    return mount.mount_statistics(_nodes(spark, d), mounts)


def _mounts(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).select("name", F.posexplode("enrichment_chunks").alias("rank", "chunk_id"))
    return rows.where("chunk_id is not null").groupBy("name", "chunk_id").agg(F.min("rank").alias("rank"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk id: the latest, then the greatest text."""
    rows = read(spark, d, "text_chunks").where("id is not null")
    latest = F.max(F.struct("ingested_at", "text")).alias("r")
    return rows.groupBy("id").agg(latest).select("id", "r.text")


def node_context(spark: SparkSession, d: str) -> DataFrame:
    texts = mount.enrichment_text(_mounts(spark, d), _chunks(spark, d).where("text is not null"))
    return mount.node_context(_nodes(spark, d), texts)


# Lexical search and keywords


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return lexical.bm25_top(asked, read(spark, d, "documents"), "doc_id", F.col("text"), K)


def _chunk_keywords(spark: SparkSession, d: str) -> DataFrame:
    return lexical.keyword_chunks(read(spark, d, "keyword_entries"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.inverted_index(_chunk_keywords(spark, d))
    return index.select("keyword", "frequency", F.array_join("chunk_ids", "|").alias("chunk_ids"))


def keyword_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.keyword_statistics(_chunk_keywords(spark, d))


def keyword_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All chunks filed under exactly a keyword of the stated query set: entries
    whose number is divisible by 50."""
    number = F.regexp_extract("entry_key", r"(\d+)$", 1).cast("long")
    wanted = read(spark, d, "keyword_entries").where(number % EVERY == 0).select("keyword")
    return lexical.lookup(_chunk_keywords(spark, d), wanted.where("keyword is not null"))


def new_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no keyword names yet."""
    return lexical.unprocessed(
        _chunks(spark, d).select(F.col("id").alias("chunk_id")), _chunk_keywords(spark, d), "chunk_id"
    )


def _words(c: Column) -> Column:
    """Distinct tokens of two or more characters, in any script; the place in the
    list is the order."""
    return F.array_distinct(F.filter(lexical.tokens(c), lambda t: F.length(t) >= 2))


def entity_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions -> the 5 most specific keywords that hold them -> their
    chunks, ranked by the words that chunk and question share."""
    q = read(spark, d, "qa_pairs").where("question is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("question"))
    bag = lambda c: F.array_join(F.array_distinct(lexical.tokens(F.col(c))), " ").alias("tokens")
    words = q.select("query_id", bag("question"), F.posexplode(_words(F.col("question"))).alias("pos", "word"))
    sized = _chunk_keywords(spark, d).groupBy("keyword").agg(F.count("*").alias("n"))
    first = graph.Window.partitionBy("word").orderBy("n", "keyword")
    similar = materialize(
        sized.select("keyword", "n", F.explode(_words(F.col("keyword"))).alias("word"))
        .join(words.groupBy("word").agg(F.count("*").alias("asked")), "word")
        .withColumn("rank", F.row_number().over(first))
        .where("rank <= 5")
    )
    wanted = broadcast_if_small(similar.select(F.col("keyword").alias("wanted")).distinct(), lexical.MAX_WORDS)
    entries = read(spark, d, "keyword_entries").join(wanted, text.strip(F.col("keyword")) == F.col("wanted"), "left_semi")
    texts = _chunks(spark, d).select("id", bag("text"))
    return lexical.entity_overlap(words, similar, lexical.keyword_chunks(entries), texts, K)


def mmr_keywords(spark: SparkSession, d: str) -> DataFrame:
    """5 diverse keywords of every chunk, from the entries that name it."""
    e = mount.sound(read(spark, d, "keyword_entries"), "entry_key", DIM, "keyword", "chunk_ids")
    rows = e.select("entry_key", text.strip(F.col("keyword")).alias("word"), "v", F.explode(F.array_distinct("chunk_ids")).alias("id")).where("word <> ''")
    chunk = mount.sound(read(spark, d, "text_chunks"), "id", DIM).select("id", F.col("v").alias("c"))
    one = rows.groupBy("id", "word").agg(F.min(F.struct("entry_key", "v")).alias("r"))
    from ..functions.vectors import cosine

    ready = one.join(chunk, "id").select(
        "id", "word", F.col("word").alias("ord"), F.round(cosine(F.col("r.v"), F.col("c")), 6).alias("relevance"), F.col("r.v").alias("v")
    )
    return lexical.mmr(ready)


def position_weight(spark: SparkSession, d: str) -> DataFrame:
    w = graph.Window.partitionBy("entry_key").orderBy("batch")
    rows = read(spark, d, "keyword_entries").select("entry_key", "batch").distinct()
    pos = F.row_number().over(w) - 1
    return rows.withColumn("weight", lexical.keyword_position_weight(pos))


# Fusion


def _ranked(spark: SparkSession, d: str, score: str, keep: int) -> DataFrame:
    best = F.max(F.when(~F.isnan(score), F.col(score)))
    rows = read(spark, d, "retrieval_results").where("query_id is not null and id is not null")
    one = rows.groupBy("query_id", "id").agg(F.round(best, 9).alias("score")).where("score is not null")
    return fusion.ranked(one, keep)


def rrf_two_way(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(
        [(_ranked(spark, d, "vector_score", 3 * K), 0.6), (_ranked(spark, d, "bm25_score", 3 * K), 0.4)], K
    )


def rrf_multi_signal(spark: SparkSession, d: str) -> DataFrame:
    boost = _ranked(spark, d, "score", 3 * K).select("query_id", "id", F.round(F.lit(1.0) / F.col("rank"), 9).alias("boost"))
    out = fusion.multi_signal(_ranked(spark, d, "vector_score", 3 * K), _ranked(spark, d, "bm25_score", 3 * K), boost, K)
    return out.select("query_id", "id", "vector_rank", "bm25_rank", "rrf_score", "keyword_boost", "score", "rank")


def rank_interleave(spark: SparkSession, d: str) -> DataFrame:
    lists = [_ranked(spark, d, c, K).select("query_id", "id", "score") for c in ("vector_score", "bm25_score")]
    return fusion.interleave(*lists).select("query_id", "id", "place")


# Splitters


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null")


def _split(spark: SparkSession, d: str, **kw) -> DataFrame:
    return splitters.split(_docs(spark, d), ["doc_id"], "text", splitters.Splitter(**kw))


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, kind="paragraph")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "text_chunks").where("chunk_index is not null").select("source_file", "chunk_index").distinct()
    return rows.withColumn("chunk_id", text.chunk_id(F.col("source_file"), F.col("chunk_index")))


def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, kind="window", size=500, overlap=50)


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, kind="sentence", size=300, least_chars=20)


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, kind="semantic")


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, kind="basic")


# Graph


def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).withColumn("o", F.struct(F.coalesce("node_type", F.lit("")), F.to_json("source_tg")))
    merged = graph.merge_nodes(rows, "o")
    return merged.select("name", "node_type", F.array_join("source_tg", "|").alias("source_tg"))


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).select("name", "node_type", F.coalesce(F.size("enrichment_chunks"), F.lit(0)).cast("long").alias("n_chunks"))
    return graph.upsert_nodes(rows.distinct().withColumn("o", F.struct("n_chunks", "node_type")), "o").drop("o")


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _event_edges(spark, d)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_event_edges(spark, d))


def adjacent_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent_edges(_edges(spark, d), _nodes(spark, d), "backward")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    out = graph.adjacency(_event_edges(spark, d))
    return out.select("name", F.array_join("successors", "|").alias("successors"), F.array_join("predecessors", "|").alias("predecessors"))


def khop_bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = _event_edges(spark, d)
    return graph.rings(edges, graph.neighbours(edges).select("name").distinct(), 3)


def bfs_forward(spark: SparkSession, d: str) -> DataFrame:
    return graph.rings(_edges(spark, d), _nodes(spark, d).select("name"), 5, "forward")


def causal_chain(spark: SparkSession, d: str) -> DataFrame:
    paths = graph.longest_paths(_event_edges(spark, d), _event_edges(spark, d).select(F.col("src").alias("name")), "forward", 4)
    return paths.select("name", F.array_join("path", " > ").alias("path"))


def node_chains(spark: SparkSession, d: str) -> DataFrame:
    paths = graph.longest_paths(_edges(spark, d), _nodes(spark, d).select("name"), "backward", 5)
    return paths.select("name", F.array_join("path", " > ").alias("path"))


def _node_results(spark: SparkSession, d: str) -> DataFrame:
    """Each query's first 3 graph results by vector score."""
    rows = _ranked(spark, d, "vector_score", 5 * K).join(_nodes(spark, d).select(F.col("name").alias("id")).distinct(), "id", "left_semi")
    return fusion.ranked(rows.drop("rank"), 3).select("query_id", "id", "score")


def expand_results(spark: SparkSession, d: str) -> DataFrame:
    out = graph.expand_results(_node_results(spark, d), _edges(spark, d), 5)
    return out.withColumn("score", F.round("score", 9))


def causal_context(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    found = _node_results(spark, d).withColumn("text", F.col("id"))
    starts = found.select(F.col("id").alias("name"))
    out = graph.causal_context(
        found, graph.longest_paths(edges, starts, "forward"), graph.longest_paths(edges, starts, "backward")
    )
    return out.select("query_id", "id", "text", "forward_length", "backward_length")


def residual_embedding(spark: SparkSession, d: str) -> DataFrame:
    base = mount.sound(_nodes(spark, d), "name", DIM)
    out = node_embed.residual_vectors(base, _edges(spark, d))
    return out.select("name", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_statistics(_nodes(spark, d), _edges(spark, d))


# Budgets


def _budget_rows(spark: SparkSession, d: str, fit: int, least: int = 0, tiers: bool = False) -> DataFrame:
    """Each query's results with a text, its token count and tier.

    Only the budget limits them: a row takes separator tokens or least tokens at
    any rate, so beyond the first fit rows (of a tier) none can be taken, and a
    query with a tenth of all results is cut before it is shuffled."""
    texts = _chunks(spark, d).where("text is not null").select("id", text.proxy_tokens(F.col("text")).alias("tokens"))
    best = F.round(F.max(F.when(~F.isnan("vector_score"), F.col("vector_score"))), 9).alias("score")
    rows = read(spark, d, "retrieval_results").where("query_id is not null and id is not null").groupBy("query_id", "id").agg(best)
    rows = rows.where("score is not null").join(texts.where(F.col("tokens") >= least), "id")
    rows = rows.withColumn("tier", F.when(F.col("id").startswith("BATCH"), 0).otherwise(1) if tiers else F.lit(0))
    w = graph.Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= fit).select("query_id", "id", "score", "tokens", "tier")


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = _budget_rows(spark, d, 700 // budget.SEPARATOR + 2).drop("tier")
    return budget.prefix(rows, ["query_id"], [F.desc("score"), F.col("id")], "tokens", 700)


def budget_supplement(spark: SparkSession, d: str) -> DataFrame:
    return budget.supplement(_budget_rows(spark, d, 900 // 60 + 2, 60).drop("tier"), ["query_id"], [F.desc("score"), F.col("id")], "tokens", 900, least=60)


def budget_two_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = _budget_rows(spark, d, 1000 // budget.SEPARATOR + 2, tiers=True)
    return budget.two_tier(rows, ["query_id"], [F.desc("score"), F.col("id")], "tokens", 1000, rest=30)


# Questions, logs, curation


def question_type(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "retrieval_records").select("question").unionByName(read(spark, d, "qa_pairs").select("question"))
    kinds = asked.where("question is not null").select(text.question_type(F.col("question")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def question_hash(spark: SparkSession, d: str) -> DataFrame:
    return caches.distinct_questions(read(spark, d, "retrieval_records"))


def question_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the log that have no good answer yet."""
    log = read(spark, d, "retrieval_records")
    return caches.questions_to_process(caches.distinct_questions(log).select("question"), log).select("question")


def question_stats(spark: SparkSession, d: str) -> DataFrame:
    return caches.question_statistics(read(spark, d, "retrieval_records").dropDuplicates(["record_id"]))


def failed_stats(spark: SparkSession, d: str) -> DataFrame:
    return caches.failures(read(spark, d, "retrieval_records").dropDuplicates(["record_id"]))


def failed_questions(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "retrieval_records").dropDuplicates(["record_id"])
    return caches.failed_questions(log, "timeout").select("question", "error").distinct()


def file_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpus whose build never succeeded."""
    log = read(spark, d, "file_records").where("tg_id is not null")
    docs = read(spark, d, "documents").where("tg_id is not null").select("tg_id").distinct()
    return caches.files_to_process(docs, log, "tg_id")


def build_stats(spark: SparkSession, d: str) -> DataFrame:
    return caches.build_statistics(read(spark, d, "file_records").dropDuplicates(["record_id"]))


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "retrieval_records").dropDuplicates(["record_id"]).where("token_usage is not null")
    kind = F.when(F.col("status") == "success", "prompt").otherwise("completion")
    return caches.token_cost(log.select(kind.alias("category"), F.col("token_usage").cast("long").alias("tokens")))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "text_chunks").select(F.coalesce("tg_id", F.lit("?")).alias("tg_id"), "text")
    return caches.fingerprint(rows, "tg_id", "text")


def format_tokens(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "retrieval_records").dropDuplicates(["record_id"]).groupBy("status").agg(F.sum("token_usage").alias("n"))
    return sums.select("status", text.format_token_count(F.col("n")).alias("shown"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = curation.titled(read(spark, d, "documents"), "doc_id", "text")
    return curation.exact_title_dedup(rows).select("key", "product", "title", "length")


def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = curation.titled(read(spark, d, "documents"), "doc_id", "text")
    return curation.fuzzy_dedup(curation.exact_title_dedup(rows))


def renumber(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "text_chunks").where("source_file is not null").select("source_file").distinct()
    return curation.renumber(files, "source_file")


def qa_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return curation.first_questions(read(spark, d, "qa_pairs"), ["id"]).select("id", "question")


def qa_stats(spark: SparkSession, d: str) -> DataFrame:
    return curation.qa_statistics(read(spark, d, "qa_pairs").dropDuplicates(["id"]))


# Literal fixtures of the parsers

FLOW = """flowchart TD
A["检查阀门"] --> B{"压力正常?"}
B -->|是| C[启动泵]
B -- 否 --> D{{停机}}
C -.-> E[记录]
C & D --> F[结束] --> G[归档]"""
SEQ = """sequenceDiagram
participant O as 操作员
participant P as 泵
O->>P: 启动
P-->>O: 就绪
loop
O->>P: 启动
end"""
BATCH = (
    '{"id":"BATCH-0001","title":"Pumps","qa_pairs":[{"id":"q1","question":" How? ","answer":"Slowly","keywords":[],'
    '"source_keywords":["pump"],"requires_causal_reasoning":true},{"question":""},{"id":"q2","question":"Why?",'
    '"difficulty":"hard","expected_hops":2}]}'
)


def mermaid_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parsing.flowchart_nodes(spark.createDataFrame([("TG-1", FLOW)], "tg_id string, code string"), "tg_id", "code")


def mermaid_edges(spark: SparkSession, d: str) -> DataFrame:
    return parsing.flowchart_edges(spark.createDataFrame([("TG-1", FLOW)], "tg_id string, code string"), "tg_id", "code")


def mermaid_sequence(spark: SparkSession, d: str) -> DataFrame:
    return parsing.sequence_messages(spark.createDataFrame([("TG-1", SEQ)], "tg_id string, code string"), "tg_id", "code")


def qa_flatten(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame([(BATCH,)], "j string").select(F.from_json("j", curation.batch_schema()).alias("b")).select("b.*")
    out = curation.flatten_batches(raw)
    return out.select(
        "source_batch", "pos", "id", "question", "answer", "difficulty", "expected_hops", "requires_graph_reasoning",
        F.array_join("keywords", "|").alias("keywords"),
    )


# Pipelines


def _store(spark: SparkSession, d: str) -> Store:
    nodes = graph.merge_nodes(
        _nodes(spark, d).where("name is not null").withColumn("o", F.struct(F.coalesce("node_type", F.lit("")), F.to_json("source_tg"))), "o"
    )
    chunks = _chunks(spark, d)
    entries = mount.sound(read(spark, d, "keyword_entries"), "entry_key", DIM, "keyword")
    word = text.strip(F.col("keyword"))
    kw_vec = entries.select(word.alias("keyword"), "v").where("keyword <> ''").groupBy("keyword").agg(F.max("v").alias("v"))
    return Store(
        materialize(nodes), materialize(_edges(spark, d)), materialize(mount.sound(_nodes(spark, d), "name", DIM)),
        materialize(chunks), materialize(mount.sound(read(spark, d, "text_chunks"), "id", DIM)),
        materialize(_mounts(spark, d)), materialize(_chunk_keywords(spark, d)), materialize(kw_vec),
    )


def _retriever(spark: SparkSession, d: str) -> tuple[Retriever, DataFrame]:
    """Over the stated query set: pairs whose number is divisible by 50."""
    r = Retriever(_store(spark, d), HashEmbedding(DIM), RetrievalConfig(keyword_threshold=0.2, context_tokens=2000, supplement_least=50))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    asked = read(spark, d, "qa_pairs").where((number % EVERY == 0) & F.col("question").isNotNull())
    return r, r.questions(asked.groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("question")))


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    r, asked = _retriever(spark, d)
    return r.hybrid(asked)


def reasoning_context(spark: SparkSession, d: str) -> DataFrame:
    r, asked = _retriever(spark, d)
    return r.reasoning(asked)["context"].select("query_id", "id", "source_type", "tokens", "score", "rank")


def answers(spark: SparkSession, d: str) -> DataFrame:
    r, asked = _retriever(spark, d)
    return r.answer(asked)


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_filter_topk, vector_overfetch_filter, keyword_threshold, similarity_topk_join, mount_stats,
        node_context, bm25_topk, inverted_index, keyword_stats, keyword_lookup, new_chunks, entity_retrieval,
        mmr_keywords, position_weight, rrf_two_way, rrf_multi_signal, rank_interleave, paragraph_chunks, chunk_ids,
        fixed_window_chunks, sentence_chunks, semantic_chunks, packed_chunks, graph_merge, node_upsert, edge_dedup,
        neighbours, adjacent_edges, adjacency, khop_bfs, bfs_forward, causal_chain, node_chains, expand_results,
        causal_context, residual_embedding, graph_stats, budget_prefix, budget_supplement, budget_two_tier,
        question_type, question_hash, question_antijoin, question_stats, failed_stats, failed_questions,
        file_antijoin, build_stats, token_cost, content_hash, format_tokens, exact_dedup, fuzzy_dedup, renumber,
        qa_first_wins, qa_stats, mermaid_nodes, mermaid_edges, mermaid_sequence, qa_flatten,
        hybrid_retrieval, reasoning_context, answers,
    )
}

from .sql import SQL  # noqa: E402,F401
