import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from procgraph.operators import lexical


def written(spark):
    """Rows that all stages so far have shuffled."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)] + ["泵", "über", "OPERATOR"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    asked = [(f"q{k:03}", text(6) + " Operator") for k in range(300)]
    asked += [("long", " ".join(f"w{k}" for k in range(400))), ("none", "zz"), ("blank", ""), ("null", None), (None, "operator w1"), ("q000", "a operator")]
    chunks = [(f"c{k:03}", text(rng.randrange(0, 30)), rng.randrange(3)) for k in range(300)]
    chunks += [("c000", "later operator w2", 7), ("empty", "", 1), ("null", None, 1), (None, "operator", 1), ("c001", None, 9)]
    chunks += [(f"d{k:02}", "w3 w4  w3 operator", 1) for k in range(30)]
    ids = [c for c, _, _ in chunks] + ["missing"]
    entries = [(" operator ", ids), ("operator", ids[:5] + [None]), ("shift operator", ids[::2]), ("w3 valve", ids[::3]), ("w3 pump", ids[5:9])]
    entries += [(f"w{k} part{j}", rng.sample(ids, 1 + j)) for k in range(0, 40, 3) for j in range(8)]
    entries += [("  ", ids), (None, ids), ("lost", None)]
    return asked, chunks, entries


def test_a_word_that_many_ask_and_hold_gives_no_row_for_every_pair(spark, tables, tmp_path):
    asked, chunks, entries = tables
    kinds = "id string, question string", "id string, text string, ingested_at long", "keyword string, chunk_ids array<string>"
    for rows, kind, name in zip(tables, kinds, ("qa_pairs", "text_chunks", "keyword_entries")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("qa_pairs", "text_chunks", "keyword_entries"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    before = written(spark)
    df = __spark_entry__.queries()["entity_retrieval"](spark, str(tmp_path))
    got = [tuple(r) for r in df.select("query_id", "id", "matched_keyword", "score", "rank").collect()]
    assert sorted(got) == sorted(con.execute(__spark_entry__.oracle_sql()["entity_retrieval"]).fetchall())
    assert len(got) > 3000
    assert written(spark) - before < 60_000  # 300 questions and 330 chunks of one word are 99,000 pairs


@pytest.mark.parametrize("blocks", [{}, {"ASKED_BLOCK": 70, "HELD_BLOCK": 50, "ROW_BLOCK": 9, "CELL_BLOCK": 25, "MAX_WORDS": 1}])
def test_entity_overlap_equals_the_join(spark, collect, tables, blocks, monkeypatch):
    for name, value in blocks.items():
        monkeypatch.setattr(lexical, name, value)
    bag = lambda c: F.array_distinct(lexical.tokens(F.col(c)))
    asked, chunks, entries = tables
    q = spark.createDataFrame([r for r in asked[:-1] if r[1] is not None], "query_id string, question string")
    texts = spark.createDataFrame(list({c: (c, t) for c, t, _ in chunks if c}.values()), "id string, text string")
    kws = lexical.keyword_chunks(spark.createDataFrame(entries, "keyword string, chunk_ids array<string>"))
    words = q.select("query_id", F.array_join(bag("question"), " ").alias("tokens"), F.posexplode(bag("question")).alias("pos", "word"))
    pairs = words.groupBy("word").agg(F.count("*").alias("asked")).join(kws.groupBy("keyword").agg(F.count("*").alias("n")))
    similar = pairs.where("array_contains(split(keyword, ' '), word)").withColumn("rank", F.length("keyword"))
    scores = q.join(texts).select("query_id", "id", F.size(F.array_intersect(bag("question"), bag("text"))).cast("double").alias("score"))
    want = lexical.entity_retrieval(words, similar, kws, scores.where("score is not null"), 7)
    cols = ("query_id", "id", "matched_keyword", "score", "rank")
    found = lexical.entity_overlap(words, similar, kws, texts.select("id", F.array_join(bag("text"), " ").alias("tokens")), 7)
    assert collect(found, *cols) == collect(want.where("query_id is not null"), *cols)
    assert lexical.entity_overlap(words.where("false"), similar, kws, texts.select("id", F.lit("w1").alias("tokens")), 7).count() == 0
