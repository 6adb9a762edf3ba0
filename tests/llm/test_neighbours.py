import numpy as np
import pytest

from procgraph.llm import neighbours
from procgraph.llm.neighbours import Weights, choose_index


def brute(ids, v, k, least):
    v = v / np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] >= least}


def test_recall_of_similar_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 64))
    v = np.concatenate([c + 0.35 * rng.normal(size=(20, 64)) for c in centres] + [rng.normal(size=(1500, 64))]).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, e array<float>").repartition(6)
    got = {(r.left, r.right) for r in neighbours.most_similar(df, "id", "e", 5, 64, 0.85).collect()}
    want = brute(ids, v.astype(np.float64), 5, 0.85)
    assert len(want) > 3000 and len(got & want) / len(want) >= 0.9
    assert len(got - want) / len(want) < 0.1


def test_faults_copies_and_ties(spark, collect):
    unit = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    data = [(f"c{k:02d}", unit, "x") for k in range(20)] + [("c00", unit, "x"), ("n", near, "x"), ("z", [0.0] * 64, "x"), ("s", [1.0] * 3, "x"),
        ("e", [], "x"), ("m", None, "x"), (None, unit, "x"), ("nan", [float("nan")] + [1.0] * 63, "x"), ("null", [None] + [1.0] * 63, "x")]
    df = spark.createDataFrame(data, "id string, e array<float>, v string")
    out = neighbours.most_similar(df, "id", "e", 5, 64)
    got = {}
    for left, right, place in collect(out, "left", "right", "place"):
        got.setdefault(left, []).append((place, right))
    first = [f"c{k:02d}" for k in range(6)]
    assert [r for _, r in sorted(got["c15"])] == first[:5]
    assert [r for _, r in sorted(got["c02"])] == [x for x in first if x != "c02"]
    assert [r for _, r in sorted(got["n"])] == first[:5]
    assert set(got) == {f"c{k:02d}" for k in range(20)} | {"n"}
    assert neighbours.most_similar(df.where("false"), "id", "e").count() == 0
    assert neighbours.most_similar(df.where("id = 'n'"), "id", "e").count() == 0


def test_recall_without_threshold(spark):
    """Half of the vectors lie in clusters, half have no structure at all."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(80, 64))
    v = np.concatenate([c + 0.3 * rng.normal(size=(25, 64)) for c in centres] + [rng.normal(size=(4000, 64))]).astype(np.float32)
    ids = [f"v{i:05d}" for i in rng.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, e array<float>").repartition(6)
    got = {(r.left, r.right) for r in neighbours.most_similar(df, "id", "e").collect()}
    want = brute(ids, v.astype(np.float64), 5, -1)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("table,key", [("text_chunks", "id"), ("keyword_entries", "entry_key"), ("graph_nodes", "name")])
def test_recall_on_project_tables(spark, table, key):
    """Every sound vector against brute force, without a threshold."""
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/{table}.parquet")
    rows = neighbours.sound_vectors(df, key, "embedding", 64).collect()
    want = brute([r.key for r in rows], np.array([r.v for r in rows], np.float64).round(12), 5, -1)
    got = {(r.left, r.right) for r in neighbours.most_similar(df, key, "embedding").collect()}
    assert len(got & want) / len(want) >= 0.9


def test_chosen_index_brings_pairs_together():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = rng.normal(size=(3000, 64))
    near = unit(base[:200] + 0.2 * rng.normal(size=(200, 64)))
    which = np.arange(200)
    loose = choose_index(unit(base[1000:1256]), unit(base[:200]), which, near, 8192, 0.5)
    strict = choose_index(unit(base[1000:1256]), unit(base[:200]), which, near, 8192, 0.99)
    assert loose[2] >= 0.5 and strict[2] >= 0.99 and strict[1] ** 2 / strict[0] >= loose[1] ** 2 / loose[0]


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(7)
    perms = np.stack([rng.permutation(12)[:5] for _ in range(30)]).astype(np.int16)
    got = np.stack([Weights(perms).agreement(i) for i in range(3, 17)])
    weight = np.zeros((30, 12))
    for i, p in enumerate(perms):
        weight[i, p] = np.arange(5, 0, -1)
    distance = np.abs(weight[3:17, None, :] - weight[None]).sum(2)
    assert np.allclose(30 - 2.0 * got, distance)
