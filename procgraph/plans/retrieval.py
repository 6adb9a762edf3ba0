"""Query-time pipelines over batches of questions.

A store holds the tables of a build; every function takes a questions frame and
answers all of its rows with one plan per step.  The walk over the graph is
sequential per question and parallel over questions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_instructions, collapse_blanks, proxy_tokens, question_type, truncate_to_tokens
from ..functions.vectors import cosine
from ..operators import budget, fusion, graph, lexical, search
from ..providers import EchoModel, EmbeddingProvider, LanguageModel, embed_column, map_column
from ..session import materialize
from .config import RetrievalConfig
from .generate import keyword_boost


#: Share of the budget that must be left for another anchor once the texts suffice.
LEFT_SHARE = 0.15


@dataclass
class Store:
    """Tables of a build: nodes (name, node_type, source_tg, properties), edges
    (src, dst, ord, ...), node_vec (name, v), chunks (id, text, ...), chunk_vec
    (id, v), mounts (name, chunk_id, rank), chunk_kw (chunk_id, keyword),
    kw_vec (keyword, v)."""

    nodes: DataFrame
    edges: DataFrame
    node_vec: DataFrame
    chunks: DataFrame
    chunk_vec: DataFrame
    mounts: DataFrame
    chunk_kw: DataFrame
    kw_vec: DataFrame


class Retriever:
    """policy, a language model, chooses the next nodes of a walk; without one the
    neighbour most similar to the question is taken.  tokens counts a column's
    tokens: the offline proxy, or functions.text.token_counter of a ranks file."""

    def __init__(
        self,
        store: Store,
        embedder: EmbeddingProvider,
        config: RetrievalConfig | None = None,
        model: LanguageModel | None = None,
        policy: LanguageModel | None = None,
        tokens: Callable[[Column], Column] = proxy_tokens,
    ):
        self.store, self.embedder = store, embedder
        self.config, self.model = config or RetrievalConfig(), model or EchoModel()
        self.policy, self.tokens = policy, tokens

    def questions(self, asked: DataFrame) -> DataFrame:
        """(query_id, question, q) with the question's vector; written once."""
        v = embed_column(asked, "query_id", "question", self.embedder, as_query=True)
        return materialize(asked.select("query_id", "question").join(v, "query_id").withColumnRenamed("v", "q"))

    # Branches

    def node_search(self, asked: DataFrame, k: int) -> DataFrame:
        """V5: nodes by cosine."""
        return search.search(asked, self.store.node_vec.select(F.col("name").alias("id"), "v"), k)

    def node_bm25(self, asked: DataFrame, k: int, node_types: list[str] | None = None) -> DataFrame:
        """L2, L3, P5: nodes by BM25 over name, sources and keywords; a type
        filter comes before the cut."""
        words = F.concat_ws(" ", "name", F.array_join("source_tg", " "), F.try_element_at("properties", F.lit("keywords")))
        posted = lexical.postings(self.store.nodes, "name", words)
        scored = lexical.bm25(asked.select("query_id", F.col("question").alias("text")), posted, self.store.nodes.count())
        if node_types:
            wanted = self.store.nodes.where(F.col("node_type").isin(*node_types)).select(F.col("name").alias("id"))
            scored = scored.join(wanted, "id", "left_semi")
        return search.top_k(scored.where("score > 0").withColumn("score", F.round("score", 6)), k)

    def anchors(self, asked: DataFrame, k: int, node_types: list[str] | None = None, devices: DataFrame | None = None) -> DataFrame:
        """Vector and BM25 ranks fused (Q-04: the type filter holds for
        BM25 only); with devices (query_id, system_device) nodes whose keywords
        resemble the device are raised (Q-05)."""
        wide = k * self.config.recall_multiplier
        vector, words = self.node_search(asked, wide), self.node_bm25(asked, wide, node_types)
        boost = None
        if devices is not None:
            vector, words = materialize(vector), materialize(words)
            listed = F.filter(F.split(F.try_element_at("properties", F.lit("keywords")), r"[\\[\\]\",\\s]+"), lambda x: x != "")
            keywords = self.store.nodes.select(F.col("name").alias("id"), listed.alias("keywords"))
            found = vector.select("query_id", "id").unionByName(words.select("query_id", "id"))
            boost = keyword_boost(devices, found, keywords, self.embedder)
        return fusion.multi_signal(vector, words, boost, k, self.config.rrf_k)

    def graph_branch(self, asked: DataFrame, k: int, node_types: list[str] | None = None) -> DataFrame:
        """Twice the nodes, type filter, neighbours, causal context, first k."""
        found = self.node_search(asked, 2 * k)
        if node_types:
            kinds = self.store.nodes.select(F.col("name").alias("id"), "node_type")
            found = found.join(kinds.where(F.col("node_type").isin(*node_types)).select("id"), "id", "left_semi")
        grown = graph.expand_results(found, self.store.edges, k).where(F.col("rank") <= k)
        grown = materialize(grown.withColumn("text", F.col("id")))
        starts = grown.select(F.col("id").alias("name"))
        n = self.config.chain_length
        forward = graph.longest_paths(self.store.edges, starts, "forward", n)
        backward = graph.longest_paths(self.store.edges, starts, "backward", n)
        return graph.causal_context(grown, forward, backward)

    def entity_branch(self, asked: DataFrame, k: int) -> DataFrame:
        """Words of the question -> similar keywords -> chunks -> cosine."""
        words = asked.select("query_id", F.posexplode(F.array_distinct(lexical.tokens(F.col("question")))).alias("pos", "word"))
        words = materialize(words.where(F.length("word") >= 2))
        once = words.select(F.col("word").alias("query_id"), "word").distinct()
        vec = embed_column(once, "query_id", "word", self.embedder).withColumnRenamed("v", "q")
        keywords = self.store.kw_vec.select(F.col("keyword").alias("id"), "v")
        near = search.search(vec, keywords, self.config.keyword_top_k, least=self.config.keyword_threshold)
        similar = near.select(F.col("query_id").alias("word"), F.col("id").alias("keyword"), "score", "rank")
        reached = words.join(similar.drop("rank", "score"), "word").join(self.store.chunk_kw.select("keyword", "chunk_id"), "keyword")
        pairs = reached.select("query_id", F.col("chunk_id").alias("id")).distinct()
        scores = (
            pairs.join(self.store.chunk_vec, "id")
            .join(asked.select("query_id", "q"), "query_id")
            .select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score"))
        )
        return lexical.entity_retrieval(words, similar, self.store.chunk_kw, scores, k)

    def hybrid(self, asked: DataFrame, k: int | None = None, node_types: list[str] | None = None) -> DataFrame:
        """Both branches fused (query_id, id, score, rank)."""
        k = k or self.config.top_k
        g = self.graph_branch(asked, k, node_types).select("query_id", "id", "rank")
        e = self.entity_branch(asked, k).select("query_id", "id", "rank")
        c = self.config
        return fusion.reciprocal_rank_fusion([(g, c.graph_weight), (e, c.entity_weight)], k, c.rrf_k)

    def retrieve(self, asked: DataFrame, mode: str = "hybrid", k: int | None = None, node_types: list[str] | None = None) -> DataFrame:
        """By mode hybrid, graph or reasoning."""
        if mode == "hybrid":
            return self.hybrid(asked, k, node_types)
        if mode == "graph":
            return self.graph_branch(asked, k or self.config.top_k, node_types)
        if mode == "reasoning":
            return self.reasoning(asked)["context"]
        raise ValueError(f"unknown mode: {mode}")

    # The walk

    def _knowledge(self, at: DataFrame, seen: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
        """The most similar unseen chunks of each question's current node."""
        rows = (
            at.select("query_id", F.col("node").alias("name"))
            .join(self.store.mounts.select("name", F.col("chunk_id").alias("id")).distinct(), "name")
            .join(seen, ["query_id", "id"], "left_anti")
            .join(chunks, "id")
            .join(self.store.chunk_vec, "id", "left")
            .join(asked.select("query_id", "q"), "query_id")
        )
        rows = rows.select("query_id", "id", "text", "tokens", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
        return search.top_k(rows, self.config.chunks_per_node)

    def _candidates(self, at: DataFrame, most: int = 5) -> DataFrame:
        """(query_id, next, n, side): successors (side 0) and predecessors (1) of
        the current node that its walk has not visited; the full_context strategy
        shows the first few of each."""
        sides = []
        for direction, place in (("forward", 0), ("backward", 1)):
            step = graph.directed(self.store.edges, direction).select(F.col("a").alias("node"), F.col("b").alias("next"), "ord")
            w = Window.partitionBy("query_id").orderBy("ord", "next")
            near = at.join(step, "node").where(~F.array_contains("path", F.col("next")))
            near = near.withColumn("n", F.row_number().over(w))
            near = near.where(F.col("n") <= most) if self.config.strategy == "full_context" else near
            sides.append(near.select("query_id", "next", "n", F.lit(place).alias("side")))
        return sides[0].unionByName(sides[1])

    def _next(self, near: DataFrame, asked: DataFrame) -> DataFrame:
        """R5, R6 with the deterministic policy: of the candidates the one most
        similar to the question, else the first; (query_id, next)."""
        scored = (
            near.join(self.store.node_vec.select(F.col("name").alias("next"), "v"), "next", "left")
            .join(asked.select("query_id", "q"), "query_id")
            .withColumn("s", F.round(cosine(F.col("q"), F.col("v")), 6))
        )
        return graph.first_per(scored, ["query_id"], [F.desc("s"), F.col("side"), F.col("n"), F.col("next")]).select("query_id", "next")

    def _told(self, at: DataFrame, near: DataFrame, asked: DataFrame, new: DataFrame) -> DataFrame:
        """R5, R6 with a policy: (query_id, next, sufficient, failed).  The model
        gets the question, the node's new texts and the candidates, and answers
        {"sufficient": bool, "next_nodes": [name]}; the first named candidate
        counts, with or without brackets.  A call that fails or gives no object is
        failed."""
        names = F.transform(F.array_sort(F.collect_list(F.struct("side", "n", "next"))), lambda c: c["next"])
        listed = near.groupBy("query_id").agg(names.alias("names"))
        texts = new.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("texts"))
        full = at.select("query_id", "node").join(asked.select("query_id", "question"), "query_id").join(listed, "query_id", "left").join(texts, "query_id", "left")
        prompt = F.concat_ws(
            "\n", F.lit("<question>"), "question", F.lit("</question>\n<node>"), "node", F.coalesce("texts", F.lit("")), F.lit("</node>\n<candidates>"),
            F.array_join("names", "\n"),
            F.lit('</candidates>\nReply in JSON: {"sufficient": whether the texts answer the question, "next_nodes": [candidate to visit]}'),
        )
        full = materialize(full.withColumn("prompt", prompt))
        said = map_column(full, "query_id", "prompt", self.policy.complete)
        j = F.from_json(F.regexp_extract(F.coalesce("output", F.lit("")), r"(?s)\{.*\}", 0), "sufficient boolean, next_nodes array<string>")
        bare = lambda x: F.regexp_replace(x, r"^[\s\[\]【】]+|[\s\[\]【】]+$", "")
        got = said.withColumn("j", j).join(full.select("query_id", F.coalesce("names", F.array().cast("array<string>")).alias("names")), "query_id")
        named = F.coalesce(F.col("j.next_nodes"), F.array().cast("array<string>"))
        valid = F.filter(F.transform(named, lambda x: F.when(F.array_contains("names", x), x).otherwise(bare(x))), lambda x: F.array_contains("names", x))
        failed = ~F.col("success") | F.col("j").isNull() | (F.col("j.sufficient").isNull() & F.col("j.next_nodes").isNull())
        return got.select(
            "query_id", F.get(valid, F.lit(0)).alias("next"), F.coalesce("j.sufficient", F.lit(False)).alias("sufficient"), failed.alias("failed")
        )

    def _choose(self, at: DataFrame, asked: DataFrame, new: DataFrame) -> DataFrame:
        """(query_id, next, sufficient, stack): where each walk goes; null ends it.

        step_by_step keeps the successors it passed over on a stack.  Where the
        choice is empty or failed it takes the first unvisited successor, then the
        latest unvisited branch of the stack (R9).  full_context then leaves the
        anchor."""
        near = self._candidates(at)
        if self.policy is not None or self.config.strategy == "step_by_step":
            near = materialize(near)
        if self.policy is None:
            choice = self._next(near, asked).withColumns({"sufficient": F.lit(False), "failed": F.lit(False)})
        else:
            choice = materialize(self._told(at, near, asked, new))
        out = at.join(choice, "query_id", "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
        if self.config.strategy == "full_context":
            return out.select("query_id", F.when(~F.col("sufficient"), F.col("next")).alias("next"), "sufficient", "stack")
        after = F.transform(F.array_sort(F.collect_list(F.struct("n", "next"))), lambda c: c["next"])
        ahead = near.where("side = 0").groupBy("query_id").agg(after.alias("ahead"))
        none = F.array().cast("array<string>")
        out = out.join(ahead, "query_id", "left").withColumn("ahead", F.coalesce("ahead", none))
        open_ = F.filter("stack", lambda x: ~F.array_contains("path", x))
        out = out.withColumn("stack", open_)
        goal = F.coalesce("next", F.get("ahead", F.lit(0)), F.try_element_at("stack", F.lit(-1)))
        out = out.withColumn("goal", goal)
        rest = F.filter("ahead", lambda x: x != F.col("goal"))
        stack = F.concat(F.filter("stack", lambda x: (x != F.col("goal")) & ~F.array_contains("ahead", x)), F.reverse(rest))
        return out.select("query_id", F.when(~F.col("sufficient"), F.col("goal")).alias("next"), "sufficient", F.coalesce(stack, none).alias("stack"))

    def walk(self, asked: DataFrame) -> dict[str, DataFrame]:
        """Knowledge (query_id, id, text, tokens, score),
        paths (query_id, anchor, path) and spent tokens (query_id, used).

        Anchors in turn, at most hops nodes each.  A node's chunks are collected
        before its tokens are checked (Q-19); a walk ends at its budget, where no
        unvisited neighbour is left, or where the policy finds the texts sufficient.
        A sufficient question goes on with its next anchor while more than
        LEFT_SHARE of its budget is left (R11); enough (query_id) lists them.
        """
        c = self.config
        chunks = self.store.chunks.where("text is not null").select("id", "text", self.tokens(F.col("text")).alias("tokens"))
        starts = materialize(self.anchors(asked, c.anchors).select("query_id", "id", "score", "rank"))
        used = asked.select("query_id", F.lit(0).cast("long").alias("used"))
        known = None
        paths = []
        enough = asked.select("query_id").where("false")
        for a in range(c.anchors):
            share = F.greatest(F.lit(800), F.floor((F.lit(c.context_tokens) - F.col("used")) / (c.anchors - a) * 1.4))
            at = (
                starts.where(F.col("rank") == a + 1)
                .join(used.where(F.col("used") < c.context_tokens), "query_id")
                .join(enough.join(used.where(F.col("used") > (1 - LEFT_SHARE) * c.context_tokens), "query_id").select("query_id"), "query_id", "left_anti")
                .select(
                    "query_id", F.col("id").alias("node"), F.array("id").alias("path"),
                    F.least(F.lit(c.context_tokens), F.col("used") + share).alias("most"),
                    F.array().cast("array<string>").alias("stack"),
                )
            )
            at = materialize(at)
            for _ in range(c.hops):
                if at.isEmpty():
                    break
                empty = at.select("query_id", F.lit("").alias("id")).where("false")
                seen = known.select("query_id", "id") if known is not None else empty
                new = materialize(self._knowledge(at, seen, asked, chunks).drop("rank"))
                known = new if known is None else materialize(known.unionByName(new))
                cost = at.select("query_id", (self.tokens(F.col("node")) + 15).alias("t")).unionByName(
                    new.select("query_id", F.col("tokens").alias("t"))
                )
                used = materialize(
                    used.join(cost.groupBy("query_id").agg(F.sum("t").alias("t")), "query_id", "left").select(
                        "query_id", (F.col("used") + F.coalesce("t", F.lit(0))).alias("used")
                    )
                )
                alive = at.join(used, "query_id").where(F.col("used") <= F.col("most")).drop("used")
                choice = self._choose(alive, asked, new)
                if self.policy is not None:
                    choice = materialize(choice)
                    enough = materialize(enough.unionByName(choice.where("sufficient").select("query_id")).distinct())
                moved = materialize(alive.drop("stack").join(choice, "query_id", "left"))
                ended = at.join(moved.where("next is not null").select("query_id"), "query_id", "left_anti")
                paths.append(ended.select("query_id", F.lit(a + 1).alias("anchor"), "path"))
                at = moved.where("next is not null").select(
                    "query_id", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), "most", "stack"
                )
            paths.append(at.select("query_id", F.lit(a + 1).alias("anchor"), "path"))
        walked = paths[0]
        for p in paths[1:]:
            walked = walked.unionByName(p)
        if known is None:
            known = chunks.select(F.lit(None).cast("string").alias("query_id"), "id", "text", "tokens", F.lit(0.0).alias("score")).where("false")
        return {"knowledge": known, "paths": walked, "used": used, "enough": enough}

    def reasoning(self, asked: DataFrame) -> dict[str, DataFrame]:
        """Walk, gap filling (J7), vector supplement (W4, R12), rescoring
        and ordering; context (query_id, id, text, score, source_type, tokens)."""
        c = self.config
        w = self.walk(asked)
        graph_rows = w["knowledge"].withColumn("source_type", F.lit("enrichment"))
        texts = self.store.chunks.where("text is not null").select("id", "text", self.tokens(F.col("text")).alias("tokens"))
        gap = self.entity_branch(asked, c.gap_top_k).select("query_id", "id", "score", "rank").join(texts, "id")
        room = gap.join(w["used"], "query_id").withColumn("room", F.lit(c.context_tokens) - F.col("used")).drop("used")
        gap = budget.prefix(room, ["query_id"], [F.col("rank")], "tokens", F.col("room"), 0)
        gap = gap.select("query_id", "id", "text", "tokens", "score").withColumn("source_type", F.lit("keyword"))
        known = materialize(fusion.first_wins([graph_rows, gap], ["query_id", "id"]))
        near = search.search(asked, self.store.chunk_vec, c.supplement_top_k)
        fresh = fusion.unseen(near, known, ["query_id", "id"]).join(texts, "id")
        fresh = fresh.withColumn("text", collapse_blanks(F.col("text"))).withColumn("tokens", self.tokens(F.col("text")))
        spent = gap.groupBy("query_id").agg(F.sum("tokens").alias("filled"))
        spent = w["used"].join(spent, "query_id", "left").select("query_id", (F.col("used") + F.coalesce("filled", F.lit(0))).alias("used"))
        spent = spent.join(w["enough"].withColumn("enough", F.lit(True)), "query_id", "left")
        cap = budget.supplement_budget(c.context_tokens, F.col("used"), F.coalesce("enough", F.lit(False)))
        fresh = fresh.join(spent, "query_id").withColumn("cap", cap).drop("enough")
        extra = budget.supplement(fresh, ["query_id"], [F.col("rank")], "tokens", F.col("cap"), self.config.supplement_least)
        extra = extra.withColumn("text", F.when(F.col("cut"), truncate_to_tokens(F.col("text"), F.col("taken"))).otherwise(F.col("text")))
        extra = extra.select("query_id", "id", "text", F.col("taken").alias("tokens"), "score").withColumn("source_type", F.lit("vector_supplement"))
        rows = known.select("query_id", "id", "text", "tokens", "source_type").unionByName(
            extra.select("query_id", "id", "text", "tokens", "source_type")
        )
        rows = materialize(rows)
        lacking = rows.select("id", "text").join(self.store.chunk_vec, "id", "left_anti").groupBy("id").agg(F.min("text").alias("text"))
        vectors = self.store.chunk_vec.select("id", "v").unionByName(embed_column(lacking, "id", "text", self.embedder))
        scored = rows.join(vectors, "id", "left").join(asked.select("query_id", "q"), "query_id")
        scored = scored.withColumn("score", F.round(cosine(F.col("q"), F.col("v")), 6)).drop("v", "q")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return {"context": scored.withColumn("rank", F.row_number().over(order)), "paths": w["paths"], "used": w["used"]}

    def assemble(self, rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
        """(query_id, context, tokens, order_hint) of context rows
        within the budget, graph rows first."""
        kinds = ["enrichment"] + (["keyword"] if self.config.gap_in_context else [])
        tier = F.when(F.col("source_type").isin(*kinds), 0).when(F.col("source_type") == "vector_supplement", 1)
        rows = rows.withColumn("tier", tier).where("tier is not null")
        rows = rows.where(fusion.source_floor(F.col("score"), F.col("source_type")))
        total = max(0, self.config.context_tokens - budget.FINAL_OVERHEAD)
        kept = budget.two_tier(rows, ["query_id"], [F.desc("score"), F.col("id")], "tokens", total)
        kept = kept.withColumn("text", F.when(F.col("cut"), truncate_to_tokens(F.col("text"), F.col("taken"))).otherwise(F.col("text")))
        parts = F.array_sort(F.collect_list(F.struct("tier", (-F.col("score")).alias("s"), "id", "text")))
        out = kept.groupBy("query_id").agg(
            F.array_join(F.transform(parts, lambda p: p["text"]), "\n---\n").alias("context"), F.sum("taken").alias("tokens")
        )
        if paths is None:
            return out.withColumn("order_hint", F.lit(""))
        steps = F.transform(F.array_sort(F.collect_list(F.struct("anchor", "path"))), lambda p: p["path"])
        hints = paths.groupBy("query_id").agg(F.array_join(F.array_distinct(F.flatten(steps)), " → ").alias("order_hint"))
        return out.join(hints, "query_id", "left").withColumn("order_hint", F.coalesce("order_hint", F.lit("")))

    def answer(self, asked: DataFrame, mode: str = "reasoning") -> DataFrame:
        """(query_id, question, output, success, error_message).  A
        question without context is answered as such, without a model call."""
        if mode == "reasoning":
            r = self.reasoning(asked)
            ready = self.assemble(r["context"], r["paths"])
        else:
            found = self.retrieve(asked, mode)
            texts = self.store.chunks.select("id", "text").unionByName(self.store.nodes.select(F.col("name").alias("id"), F.col("name").alias("text")))
            rows = found.select("query_id", "id", "rank").join(texts.where("text is not null"), "id")
            rows = rows.withColumn("tokens", self.tokens(F.col("text")))
            limit = max(0, self.config.context_tokens - budget.ANSWER_OVERHEAD)
            kept = budget.prefix(rows, ["query_id"], [F.col("rank"), F.col("id")], "tokens", limit)
            parts = F.array_sort(F.collect_list(F.struct("rank", "id", "text")))
            ready = kept.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n---\n").alias("context"))
            ready = ready.withColumn("order_hint", F.lit(""))
        full = asked.select("query_id", "question").join(ready, "query_id", "left")
        kind = question_type(F.col("question"))
        prompt = F.concat(
            F.lit("<reference>\n"), F.coalesce("context", F.lit("")), F.lit("\n</reference>\n"),
            F.when(F.col("order_hint") != "", F.concat(F.lit("suggested order: "), "order_hint", F.lit("\n"))).otherwise(""),
            F.lit("<question>\n"), "question", F.lit("\n</question>\n"), answer_instructions(kind),
        )
        model = self.model
        told = map_column(full.where("context <> ''").withColumn("prompt", prompt), "query_id", "prompt", model.complete)
        silent = full.where("context is null or context = ''").select(
            "query_id", F.lit("无法回答：未检索到相关参考资料。").alias("output"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_message")
        )
        return asked.select("query_id", "question").join(told.unionByName(silent), "query_id")
