import random
from collections import defaultdict

from procgraph.llm import ranking, topn


def brute(entries, n):
    best = defaultdict(dict)
    for g, i, s in entries:
        best[g][i] = max(s, best[g].get(i, s))
    return sorted((g, i) for g, d in best.items() for i, _ in sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n])


def test_top_n_equals_brute_force(spark, collect):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", f"i{rng.randrange(300):03d}", rng.randrange(50) / 50) for _ in range(8000)]
    data += [("ties", f"t{k:04d}", 1.0) for k in range(500)]
    df = spark.createDataFrame(data, "g string, item string, score double").repartition(5)
    assert collect(topn.top_n(df, 6), "g", "item") == brute(data, 6)


def test_entries_leave_out_what_does_not_count(spark, collect):
    nan = float("nan")
    data = [
        ("n", ["a", "b", None, "d", "a"], [1.0, nan, 3.0, None, 2.0], 1), ("n", ["x", "y"], [0.5], 1), (None, ["z"], [9.0], 1),
        ("m", None, [1.0], 1), ("m", ["q"], None, 1), ("n", ["x"], [0.5], 1),
    ]
    df = spark.createDataFrame(data, "node_id string, ids array<string>, scores array<double>, score int")
    entries = topn.scored_entries(df, "node_id", "ids", "scores")
    assert collect(topn.top_n(entries, 6), "g", "item", "score", "rank") == [("n", "a", 2.0, 1), ("n", "x", 0.5, 2)]
    assert topn.top_n(entries.where("false"), 6).count() == 0


def test_rank_aggregation_buckets_agree_with_plain_ranks(spark, collect):
    rng = random.Random(2)
    data = []
    for k in range(600):
        s = [rng.choice([None, float("nan"), rng.random() * scale, 0.5 * scale]) for scale in (1, 1000, 0.01)]
        data.append(("q1" if k < 450 else f"q{k % 7 + 2}", f"r{k:03d}", *s, "x"))
    data.append((None, "r", 1.0, 1.0, 1.0, "x"))
    df = spark.createDataFrame(data, "q string, id string, a double, b double, c double, item string")
    plain = ranking.aggregate_ranks(df, "q", "id", ["a", "b", "c"])
    cut = ranking.aggregate_ranks(df, "q", "id", ["a", "b", "c"], hot_rows=50)
    cols = ["g", "item", "n", "r0", "r1", "r2", "rho"]
    assert collect(plain, *cols) == collect(cut, *cols)
    full = ranking.full_ranking(plain)
    by_group = defaultdict(list)
    for r in full.collect():
        by_group[r.g].append((r.place, (r.log_p, r.mean_rank, r.item)))
    for places in by_group.values():
        places.sort()
        assert [p for p, _ in places] == list(range(1, len(places) + 1))
        assert [o for _, o in places] == sorted(o for _, o in places)


def test_dominating_results_come_first_and_are_certain(spark, collect):
    data = [("q", f"r{k:02d}", float(-k), 1e6 - k, 0.1 / (k + 1)) for k in range(30)]
    df = spark.createDataFrame(data, "q string, id string, a double, b double, c double")
    agg = ranking.aggregate_ranks(df, "q", "id", ["a", "b", "c"])
    assert collect(ranking.first_ranked(agg, 5), "item") == [(f"r{k:02d}",) for k in range(5)]
    assert collect(ranking.certain_first(agg, 5, 3), "item") == [(f"r{k:02d}",) for k in range(5)]
    # One score with a huge range does not decide alone.
    swapped = [("q", i, a, (1e9 if i == "r29" else b), c) for _, i, a, b, c in data]
    agg = ranking.aggregate_ranks(spark.createDataFrame(swapped, df.schema), "q", "id", ["a", "b", "c"])
    assert ("r29",) not in collect(ranking.first_ranked(agg, 1), "item")
    assert ranking.certain_first(agg.where("false"), 5, 3).count() == 0


def test_certain_results_equal_brute_force(spark, collect):
    rng = random.Random(3)
    data = [(f"q{k % 20}", f"r{k:03d}", *[rng.choice([None, rng.randrange(9) / 9, rng.random()]) for _ in "abc"]) for k in range(400)]
    low = lambda x: -1.0 if x is None else x
    want = []
    for q, i, *s in data:
        rivals = [1 for p, j, *t in data if p == q and j != i and any(low(y) >= low(x) for x, y in zip(s, t))]
        if len(rivals) <= 4:
            want.append((q, i))
    df = spark.createDataFrame(data, "q string, id string, a double, b double, c double")
    got = ranking.certain_first(ranking.aggregate_ranks(df, "q", "id", ["a", "b", "c"]), 5, 3)
    assert collect(got, "g", "item") == sorted(want)
