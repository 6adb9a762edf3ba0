"""BM25 over any text table (L1-L3) and keyword tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import broadcast_if_small, filled, materialize

#: Separators of the tokenizer that needs no dictionary.
SEPARATORS = " \t\n\x0b\f\r，。！？；：、（）【】《》\""
#: Parameters of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries in one broadcast and documents in one product of matrices.
QUERY_BLOCK, DOC_BLOCK = 1000, 500
#: Questions and chunks of a word in one group, compared rows and cells of a matrix, words in one broadcast.
ASKED_BLOCK, HELD_BLOCK, ROW_BLOCK, CELL_BLOCK, MAX_WORDS = 20_000, 20_000, 512, 100_000, 200_000


def tokens(c: Column) -> Column:
    """L1: lower case, split at white space and CJK punctuation, blanks dropped."""
    # One blank for each separator, so that the split needs no pattern and no function runs per token.
    blanks = F.translate(F.lower(c), SEPARATORS, " " * len(SEPARATORS))
    return F.array_remove(F.split(blanks, " "), "")


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, term, tf, dl); texts without token have no posting.  The term counts
    are added before they are shuffled."""
    return (
        docs.select(F.col(f"`{key}`").alias("id"), tokens(text).alias("t"))
        .select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
        .groupBy("id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_weights(posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): ln((N - df + 0.5) / (df + 0.5)), negative values replaced
    by EPSILON times the mean of all."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, posted: DataFrame, n_docs: int) -> DataFrame:
    """L3: (query_id, id, score) of documents that share a term with the query;
    repeated query terms count again.  queries: (query_id, text).

    The statistics run over all documents; only postings of the queries' terms
    are joined.
    """
    total = posted.select("id", "dl").distinct().agg(F.sum("dl")).first()[0] or 0
    average = float(total) / max(n_docs, 1)
    asked = (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    weights = term_weights(posted, n_docs)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
    return (
        posted.join(asked, "term")
        .join(weights, "term")
        .groupBy("query_id", "id")
        .agg(F.sum(part * F.col("qtf")).alias("score"))
    )


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_top(queries: DataFrame, docs: DataFrame, key: str, text: Column, k: int, digits: int = 6) -> DataFrame:
    """L3 with its cut: (query_id, id, score, rank) of the k best documents with a
    positive score; ties go to the smaller id.

    The queries' terms and weights travel as a broadcast, QUERY_BLOCK queries at a
    time, and documents are scored where they lie, so a word that all documents
    hold is no hot key; k rows per query leave a batch.  Statistics run over all
    documents; of them only (term, count) is shuffled, added up before.
    """
    words = docs.select(F.col(f"`{key}`").alias("id"), tokens(text).alias("t"))
    n_docs, total = words.agg(F.count("*"), F.sum(F.size("t"))).first()
    average = float(total or 0) / max(n_docs, 1) or 1.0
    seen = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = materialize(seen.withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    low = EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    weight = F.when(F.col("raw") < 0, F.lit(low)).otherwise(F.col("raw"))
    asked = asked_terms(queries).join(raw.select("term", weight.alias("idf")), "term")
    numbered = materialize(asked.withColumn("weight", F.col("idf") * F.col("qtf")).select("query_id", "term", "weight"))
    times = max(1, -(-numbered.select("query_id").distinct().count() // QUERY_BLOCK))
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    out = None
    for block in range(times):
        some = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(times)) == block).toPandas()
        found = words.mapInArrow(_scores(docs.sparkSession, some, average, k, digits), schema)
        found = found if times == 1 else materialize(found)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scores(spark, asked: pd.DataFrame, average: float, k: int, digits: int):
    """An Arrow function from (id, tokens) to the k best of every query in a batch."""
    names, terms = sorted(asked["query_id"].unique()), sorted(asked["term"].unique())
    weights = np.zeros((len(names), len(terms)))
    place = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    weights[asked["query_id"].map(place[0]), asked["term"].map(place[1])] = asked["weight"]
    shared = spark.sparkContext.broadcast((names, terms, weights))

    def score(batches):
        names, terms, weights = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, DOC_BLOCK):
                batch = whole.slice(low, DOC_BLOCK)
                lists = batch.column(1)
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                term = pc.index_in(lists.flatten(), pa.array(terms, lists.type.value_type)).to_numpy(zero_copy_only=False)
                doc, known = np.repeat(np.arange(len(length)), length), ~np.isnan(term)
                tf = np.zeros((len(terms), len(length)))
                np.add.at(tf, (term[known].astype(int), doc[known]), 1.0)
                used = tf.any(1)
                tf = tf[used]
                s = np.round(weights[:, used] @ (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))), digits)
                cut = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1], 0.0) if s.shape[1] > k else np.zeros(len(names))
                a, b = np.nonzero((s >= cut[:, None]) & (s > 0))
                ids = pa.array(names).take(pa.array(a))
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).take(pa.array(b)), pa.array(s[a, b])], ["query_id", "id", "score"])

    return score if names else lambda batches: iter(())


def inverted_index(chunk_kw: DataFrame) -> DataFrame:
    """(keyword, frequency, chunk_ids) of (chunk_id, keyword) rows: stripped,
    blanks dropped, frequency = distinct chunks."""
    k = strip(F.col("keyword"))
    rows = chunk_kw.select(k.alias("keyword"), "chunk_id").where("keyword <> '' and chunk_id is not null").distinct()
    return rows.groupBy("keyword").agg(F.count("*").alias("frequency"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def keyword_chunks(entries: DataFrame) -> DataFrame:
    """(chunk_id, keyword) rows of an entries table, each pair once."""
    return (
        entries.select(strip(F.col("keyword")).alias("keyword"), F.explode("chunk_ids").alias("chunk_id"))
        .where("keyword <> '' and chunk_id is not null")
        .distinct()
    )


def keyword_statistics(chunk_kw: DataFrame) -> DataFrame:
    """A2: totals and averages (2 digits, 0 for an empty table)."""
    pairs = chunk_kw.distinct()
    return pairs.agg(
        F.countDistinct("keyword").alias("n_keywords"),
        F.countDistinct("chunk_id").alias("n_chunks"),
        F.count("*").alias("n_pairs"),
    ).select(
        "*",
        F.when(F.col("n_keywords") > 0, F.round(F.col("n_pairs") / F.col("n_keywords"), 2)).otherwise(0.0).alias("chunks_per_keyword"),
        F.when(F.col("n_chunks") > 0, F.round(F.col("n_pairs") / F.col("n_chunks"), 2)).otherwise(0.0).alias("keywords_per_chunk"),
    )


def lookup(chunk_kw: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of exactly these keywords."""
    w = wanted.select(strip(F.col("keyword")).alias("keyword")).distinct()
    return chunk_kw.join(w, "keyword").select("keyword", "chunk_id").distinct()


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def keyword_position_weight(pos: Column) -> Column:
    """1 - 0.1 per place, counted from 0."""
    return F.round(F.lit(1.0) - pos * F.lit(0.1), 6)


def split_known(keywords: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keywords with their vector where one is known, and known = false elsewhere."""
    return keywords.join(vectors, "keyword", "left").withColumn("known", F.col("v").isNotNull())


def mmr(rows: DataFrame, n: int = 5, diversity: float = 0.3) -> DataFrame:
    """(id, word, pos, relevance): n words per id, each the best of
    (1 - diversity) * relevance - diversity * greatest similarity to those
    chosen; the first wins a tie.  rows: (id, word, ord, relevance, v).

    The choice is sequential, so each id's candidates are one Arrow group; they
    are words of one text.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1)[:, None] + 1e-9
        rel = pdf["relevance"].to_numpy()
        alike = v @ v.T
        chosen: list[int] = []
        left = np.ones(len(pdf), bool)
        while left.any() and len(chosen) < n:
            near = alike[:, chosen].max(1) if chosen else np.zeros(len(pdf))
            score = (rel if not chosen else (1 - diversity) * rel - diversity * near).copy()
            score[~left] = -np.inf
            chosen.append(int(np.argmax(score)))
            left[chosen[-1]] = False
        out = pdf.iloc[chosen][["id", "word", "relevance"]]
        return out.assign(pos=np.arange(len(chosen), dtype="int32"))[["id", "word", "pos", "relevance"]]

    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("id").applyInPandas(choose, f"id {kind}, word string, pos int, relevance double")


def max_sum(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n most relevant words of every id."""
    w = Window.partitionBy("id").orderBy(F.desc("relevance"), "ord")
    return rows.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < n).select("id", "word", "pos", "relevance")


def text_rank(docs: DataFrame, key: str, text: Column, window: int = 5, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, word, score) by co-occurrence ranking inside each text.  Edges
    never cross texts, so each text is one row of an Arrow batch."""
    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, words in zip(pdf["id"], pdf["w"]):
                seq = [w for w in words if len(w) >= 2]
                names = {w: i for i, w in enumerate(dict.fromkeys(seq))}
                if not names:
                    continue
                weight: dict[tuple[int, int], float] = {}
                for i, a in enumerate(seq):
                    for b in seq[i + 1 : i + window]:
                        if a != b:
                            for x, y in ((names[a], names[b]), (names[b], names[a])):
                                weight[x, y] = weight.get((x, y), 0.0) + 1.0
                out = np.zeros(len(names))
                for (x, _), w in weight.items():
                    out[x] += w
                score = np.ones(len(names))
                src, dst = np.array([k for k in weight] or [(0, 0)]).T
                share = np.array([w / out[x] for (x, _), w in weight.items()] or [0.0])
                for _ in range(rounds):
                    score = (1 - damping) + damping * np.bincount(dst, score[src] * share, len(names))
                rows += [(k, w, float(score[i])) for w, i in names.items()]
            yield pd.DataFrame(rows, columns=["id", "word", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("id"), tokens(text).alias("w")).where("w is not null").mapInPandas(filled(rank), f"id {kind}, word string, score double"
    )


def entity_retrieval(
    query_keywords: DataFrame, similar: DataFrame, chunk_kw: DataFrame, chunk_scores: DataFrame, k: int
) -> DataFrame:
    """Query keywords -> similar index keywords -> their chunks, each under
    its first keyword -> the k most similar chunks.

    query_keywords (query_id, word, pos), similar (word, keyword, score, rank),
    chunk_scores (query_id, id, score).
    """
    reached = (
        query_keywords.select("query_id", "word", "pos")
        .join(similar.select("word", "keyword", "rank"), "word")
        .join(chunk_kw.select("keyword", "chunk_id"), "keyword")
        .groupBy("query_id", F.col("chunk_id").alias("id"))
        .agg(F.min(F.struct("pos", "rank", "keyword"))["keyword"].alias("matched_keyword"))
    )
    scored = reached.join(chunk_scores.select("query_id", "id", "score"), ["query_id", "id"]).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entity_overlap(words: DataFrame, similar: DataFrame, chunk_kw: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """J7 with the number of shared tokens as similarity: what entity_retrieval
    gives, without a row for every question and chunk.

    words (query_id, word, pos, tokens), similar (word, keyword, rank, n, asked)
    with the chunks of the keyword and the questions of the word, texts (id,
    tokens); tokens are distinct and joined by a blank.

    All questions of a word reach the same chunks, so these meet in groups of the
    word, split by ASKED_BLOCK and HELD_BLOCK.  One of the k best chunks of a
    question is among the k best under each of its words that reach it, so k rows
    of a question leave a group and show the first keyword too.
    """
    size = similar.groupBy("word").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"))
    parts = size.select("word", F.ceil(F.col("asked") / ASKED_BLOCK).alias("qs"), F.ceil(F.col("n") / HELD_BLOCK).alias("cs"))
    parts = broadcast_if_small(materialize(parts), MAX_WORDS)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    reached = (
        chunk_kw.join(broadcast_if_small(similar.select("word", "keyword", "rank"), 5 * MAX_WORDS), "keyword")
        .groupBy("word", F.col("chunk_id").alias("id"))
        .agg(F.min(F.struct("rank", "keyword")).alias("m"))
    )
    held = texts.where("tokens is not null").join(reached, "id").join(parts, "word")
    held = held.select(F.col("word").alias("word"), each("qs").alias("a"), block("id", "cs").alias("b"), "id", "m.rank", "m.keyword", "tokens")
    asked = words.where("query_id is not null").join(parts, "word")
    asked = asked.select(F.col("word").alias("word"), block("query_id", "qs").alias("a"), each("cs").alias("b"), "query_id", "pos", "tokens")
    by = ["word", "a", "b"]
    kinds = [(c, t) for f in (asked, held) for c, t in f.dtypes if c not in (*by, "tokens")]
    schema = ", ".join(f"{c} {t}" for c, t in [*kinds, ("score", "double")])
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_most_shared(k), schema)
    first = found.repartition("query_id").groupBy("query_id", "id", "score").agg(F.min(F.struct("pos", "rank", "keyword"))["keyword"].alias("matched_keyword"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "matched_keyword", "score", "rank")


def _most_shared(k: int):
    """An Arrow function from the questions and the chunks of a word to the k chunks
    of every question that share most tokens with it; ties go to the smaller id.

    Only tokens of both sides count.  Questions that are then the same are compared
    once, and of chunks that are then the same only the k first can be among the best.
    """

    def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        lists = pc.split_pattern(texts, " ")
        return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten()

    def coded(owner: np.ndarray, flat: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy()
        return owner[code >= 0], code[code >= 0]

    def sets(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of every row's set, and the sets."""
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        ends = np.searchsorted(owner, np.arange(n + 1))
        seen: dict[bytes, int] = {}
        number = [seen.setdefault(code[a:b].tobytes(), len(seen)) for a, b in zip(ends, ends[1:])]
        return np.array(number), [np.frombuffer(x, code.dtype) for x in seen]

    def best(questions: list[np.ndarray], chunks: list[np.ndarray], n_tokens: int) -> np.ndarray:
        """score * chunks + places before the end, of the k best of every question, else -1."""
        n, out = len(chunks), np.full((len(questions), k), -1, np.int64)
        length = np.array([len(x) for x in questions])
        order, blocks = np.argsort(length, kind="stable"), []
        for at in range(0, len(order), ROW_BLOCK):
            some = order[at : at + ROW_BLOCK]
            wide = np.full((len(some), length[some[-1]]), n_tokens)
            for i, q in enumerate(some):
                wide[i, : length[q]] = questions[q]
            blocks.append((some, wide.T))
        heavy = np.cumsum([len(x) for x in chunks])
        kind, low = (np.uint8 if length.max() < 256 else np.int32), 0
        while low < n:
            high = max(low + 1, min(low + 2 * ROW_BLOCK, int(np.searchsorted(heavy, (heavy[low - 1] if low else 0) + CELL_BLOCK, "right"))))
            token = np.concatenate(chunks[low:high])
            local, row = np.unique(token, return_inverse=True)
            has = np.zeros((len(local) + 1, high - low), kind)
            has[row, np.repeat(np.arange(high - low), [len(x) for x in chunks[low:high]])] = 1
            place = np.full(n_tokens + 1, len(local))
            place[local] = np.arange(len(local))
            for some, tokens_of in blocks:
                score = np.zeros((len(some), high - low), kind)
                for t in place[tokens_of]:
                    score += has[t]
                key = np.hstack([out[some], score.astype(np.int64) * n + np.arange(n - 1 - low, n - 1 - high, -1)])
                out[some] = np.partition(key, -k, axis=1)[:, -k:]
            low = high
        return out

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({})
        asked, held = asked.combine_chunks(), held.sort_by("id").combine_chunks()
        of_q, words_q = split(asked["tokens"].combine_chunks())
        of_c, words_c = split(held["tokens"].combine_chunks())
        known = pc.unique(words_c)
        known = known.filter(pc.and_(pc.is_in(known, pc.unique(words_q)), pc.not_equal(known, "")))
        q, questions = sets(*coded(of_q, words_q, known), asked.num_rows)
        c, chunks = sets(*coded(of_c, words_c, known), held.num_rows)
        order = np.argsort(c, kind="stable")
        nth = np.arange(len(c)) - np.searchsorted(c[order], c[order])
        kept = np.sort(order[nth < k])
        key = best(questions, [chunks[x] for x in c[kept]], len(known))[q]
        row, column = np.nonzero(key >= 0)
        key, n = key[row, column], len(kept)
        columns = [asked[x].take(pa.array(row)) for x in ("query_id", "pos")]
        columns += [held[x].take(pa.array(kept[n - 1 - key % n])) for x in ("id", "rank", "keyword")]
        return pa.table([*columns, pa.array((key // n).astype(np.float64))], ["query_id", "pos", "id", "rank", "keyword", "score"])

    return run
