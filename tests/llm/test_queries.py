"""Queries without SQL against brute force, over the whole smallest tables."""

import math
import os
import re
import unicodedata
from collections import defaultdict

import pytest

from procgraph.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_terms(spark):
    known = {r.id for r in table(spark, "text_chunks").select("id").distinct().collect()} - {None}
    entries = {r.entry_key: r for r in table(spark, "keyword_entries").collect()}
    times, chunks = defaultdict(int), defaultdict(set)
    for r in entries.values():
        word = " ".join(unicodedata.normalize("NFKC", r.keyword or "").split()).lower()
        if word:
            ids = [c for c in r.chunk_ids or [] if c is not None]
            times[word] += len(ids)
            chunks[word] |= set(ids) & known
    mark = lambda n: "rare" if n < 3 else "common" if n * 100 > 5 * len(known) else None
    want = {(w, n, len(chunks[w]), mark(len(chunks[w]))) for w, n in times.items()}
    got = {(r.keyword, r.occurrences, r.n_records, r.mark) for r in queries.p7_terms(spark, FOLDER).collect()}
    assert got == want
    assert {(r.keyword, r.mark) for r in queries.p7_found(spark, FOLDER).collect()} == {(w, m) for w, _, _, m in want if m}


def test_containers(spark):
    lengths = {r.doc_id: r.n_tokens for r in packing.token_lengths(table(spark, "documents"), "doc_id", "text").collect()}
    used, pieces = defaultdict(int), defaultdict(list)
    for r in queries.p8_containers(spark, FOLDER).collect():
        pieces[r.doc_id].append((r.token_start, r.tokens))
        if r.container is not None:
            used[r.container] += r.tokens
    assert pieces.keys() == lengths.keys() and max(used.values()) <= 2048
    for k, n in lengths.items():
        at = 0
        for start, size in sorted(pieces[k]):  # every token once, and no piece more than needed
            assert start == at
            at += size
        assert at == n and len(pieces[k]) == max(1, math.ceil(n / 2048))
    least = math.ceil(sum(lengths.values()) / 2048)
    assert least <= len(used) <= least + 2
    assert {r.doc_id for r in queries.p8_found(spark, FOLDER).collect()} == {k for k, n in lengths.items() if n > 2048}


def test_leaks(spark):
    def fold(t):
        return re.sub(r"[\W_]+", "", re.sub(r"<[^<>]*>", "", unicodedata.normalize("NFKC", t or "")).lower())

    grams = {24: defaultdict(set), 60: defaultdict(set)}
    for r in table(spark, "eval_items").collect():
        need = 24 if r.lang == "zh" else 60
        for t in map(fold, (r.question, r.passage)):
            for i in range(len(t) - need + 1):
                grams[need][t[i : i + need]].add(r.item_id)
    want = set()
    for r in table(spark, "documents").collect():
        t = fold(r.text)
        for need, known in grams.items():
            for i in range(len(t) - need + 1):
                want |= {(r.doc_id, x) for x in known.get(t[i : i + need], ())}
    assert want and {(r.doc_id, r.item_id) for r in queries.p9_found(spark, FOLDER).collect()} == want


def test_pieces(spark):
    trim = lambda t: (t or "").strip(" \t\r\n")
    texts = defaultdict(set)
    for r in table(spark, "text_chunks").collect():
        texts[r.id].add(trim(r.text))
    rows = defaultdict(list)
    for r in queries.p1_pieces(spark, FOLDER).where("id is not null").collect():
        rows[r.id].append(r)
    assert rows.keys() == {k for k, v in texts.items() if k and any(len(t) > 500 for t in v)}
    for k, parts in rows.items():
        parts.sort(key=lambda r: r.piece_index)
        whole = parts[0].piece + "".join(p.piece[50:] for p in parts[1:])
        assert whole in texts[k] and all(len(p.piece) <= 500 for p in parts)
        assert all(a.piece[-50:] == b.piece[:50] for a, b in zip(parts, parts[1:]))
