import random

import pytest

from procgraph.llm import leakage
from procgraph.llm.leakage import fold, leaked_runs, template_runs

ITEMS = [
    (1, "en", "How long must gear reducer ZS-4270 rest?", "Nobody may enter the pit below bag filter AG-8466 until ink cartridge BL-9990 shows 652 mm twice, 47 minutes apart."),
    (2, "zh", "要多久？", "试验中安全阀 LT-6459从75.4 L/min跌到491 kg，根源在于螺杆压缩机 RC-8449的滤芯到第7天已经结垢。"),
    (3, None, None, None),
]


def brute(docs, items, zh=24, other=60):
    out = set()
    for d, t in docs:
        s = fold(t or "")
        for i, lang, *parts in items:
            need = zh if lang == "zh" else other
            for p in parts:
                p = fold(p or "")
                if any(p[a : a + need] in s for a in range(len(p) - need + 1)):
                    out.add((d, i))
    return sorted(out)


def test_runs_equal_brute_force(spark, collect):
    rng = random.Random(8)
    docs = []
    for k in range(300):
        _, _, _, p = ITEMS[rng.randrange(2)]
        a = rng.randrange(len(p))
        cut = p[a : a + rng.randrange(10, 110)]
        cut = {0: cut, 1: cut.upper(), 2: cut.replace(" ", "\n> "), 3: "<i>" + "</i><b>".join(cut) + "</b>"}[k % 4]
        docs.append((k, f"Intro 4 5{cut}7 kPa, the end of HX-1234." + " filler" * rng.randrange(3)))
    docs += [(900, None), (901, ""), (902, ITEMS[0][3] + " word" * 50_000), (903, ITEMS[0][3]), (903, ITEMS[0][3])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, passage string")
    got = leaked_runs(df, "doc_id", "text", items.withColumnRenamed("item_id", "item"), "item", ["question", "passage"], "lang", 60, {"zh": 24})
    assert sorted(set(collect(got, "doc_id", "item"))) == brute(docs, ITEMS)
    assert min(r[0] for r in collect(got, "length")) >= 24


def test_long_texts_in_pieces(spark, collect, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    p = ITEMS[0][3]
    docs = [(k, "x" * k + p + "y" * 900 + p[:70]) for k in range(0, 700, 23)] + [(9999, "z" * 2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, passage string")
    got = collect(leaked_runs(df, "doc_id", "text", items, "item_id", ["passage"]), "doc_id", "start", "length")
    whole = len(fold(p))
    assert [g for g in got if g[2] == whole] == [(k, k, whole) for k, _ in docs[:-1]]
    assert len(got) == (len(docs) - 1) * (2 if len(fold(p[:70])) >= 60 else 1)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, passage string")
    docs = spark.createDataFrame([(1, ITEMS[0][3])], "doc_id long, text string")
    args = ("doc_id", "text", items, "item_id", ["question", "passage"])
    assert leaked_runs(docs.where("false"), *args).count() == 0
    assert leaked_runs(docs, "doc_id", "text", items.where("false"), "item_id", ["question", "passage"]).count() == 0
    assert template_runs(docs.where("false"), *args).count() == 0


def test_runs_that_begin_and_end_in_numbers(spark, collect):
    """Rows of digits and runs cut inside a number, against brute force, on both paths."""
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    items = [(k, "en", "What is the log?", f"Meter log {number(20)}, {number(7)}: {number(90)} of run {number(3)} at {number(12)}") for k in range(12)]
    docs = []
    for k in range(240):
        p = items[rng.randrange(12)][3]
        a = rng.randrange(len(p))
        docs.append((k, f"{number(4)}{p[a : a + rng.randrange(20, 130)]}{number(5)} x{number(60)}" * rng.choice([1, 1, 2])))
    docs += [(500, items[0][3][10:90]), (501, number(300)), (502, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = spark.createDataFrame(items, "item_id long, lang string, question string, passage string")
    args = (df, "doc_id", "text", held, "item_id", ["question", "passage"], "lang", 60, {"zh": 24})
    want = brute(docs, items)
    assert len(want) > 50 and sorted(set(collect(leaked_runs(*args), "doc_id", "item_id"))) == want


def test_shuffle_join_beyond_the_broadcast_limit(spark, collect, monkeypatch):
    rng = random.Random(13)
    docs = []
    for k in range(200):
        p = ITEMS[rng.randrange(2)][3]
        a = rng.randrange(len(p))
        docs.append((k, "Intro 4 5" + p[a : a + rng.randrange(10, 110)] + "7 kPa. " + p[:30] * 3))
    df = spark.createDataFrame(docs + docs[:5] + [(900, None), (901, "")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, passage string")
    args = (df, "doc_id", "text", items, "item_id", ["question", "passage"], "lang", 60, {"zh": 24})
    one = sorted(set(collect(leaked_runs(*args), "doc_id", "item_id", "part", "start", "length")))
    templates = sorted(set(collect(template_runs(*args[:7], 40, {"zh": 16}))))
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 60)
    assert one and collect(leaked_runs(*args), "doc_id", "item_id", "part", "start", "length") == one
    assert templates and sorted(set(collect(template_runs(*args[:7], 40, {"zh": 16})))) == templates


def test_recall_of_planted_rewrites(spark, collect):
    """Numbers, units and machines of a passage are exchanged, each for one other."""
    rng = random.Random(14)
    machines = ["bag filter", "gear reducer", "ink cartridge", "storage silo", "belt conveyor", "heat exchanger"]
    units = ["kPa", "bar", "psi", "mm", "°C", "L/min", "MPa", "kW", "rpm", "Nm", "GHz", "µs"]
    code = lambda: f"{rng.choice(machines)} {chr(65 + rng.randrange(26))}{rng.choice(['', 'X'])}-{rng.randrange(1, 9999)}"
    value = lambda: f"{rng.randrange(1, 900)}{rng.choice(['', '.5'])} {rng.choice(units)}"
    frames = [
        "Before the night shift starts, nobody may open {a} while {b} still shows more than {v} on the lower gauge.",
        "When {a} falls below {v} twice in a row, the crew should isolate {b} and report this to the control room.",
        "It took the fitters a whole morning to see that {a} had been fed by {b} at {v} instead of {w} as drawn.",
    ]
    fill = lambda f: f.format(a=code(), b=code(), v=value(), w=value())
    items = [(k, "en", fill(f)) for k, f in enumerate(frames)]
    docs = [(10 * n + k, "Log. " + fill(f) + " End of log.") for n in range(40) for k, f in enumerate(frames)]
    docs += [(10_000 + n, "The crew of the night shift should open the control room and report what it had been told.") for n in range(20)]
    got = template_runs(
        spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text",
        spark.createDataFrame(items, "item_id long, lang string, passage string"), "item_id", ["passage"], "lang", 40,
    )
    found = {(d, i) for d, i in collect(got, "doc_id", "item_id")}
    planted = {(d, d % 10) for d, _ in docs if d < 10_000}
    assert found <= planted and len(found) >= 0.95 * len(planted)


@pytest.mark.parametrize("lang", ["lang", None])
def test_chinese_questions_have_windows_of_their_own(spark, collect, lang):
    q = "当缓冲罐 SC-1587连续68分钟处于38.8 %时，液位计 DR-8356上的哪一个示值说明班组可以放行？"
    other = q.replace("SC-1587", "HX-2222").replace("68", "7").replace("DR-8356", "TK-3333")
    docs = spark.createDataFrame([(1, "班前会。" + other), (2, "什么也没有。"), (3, "处于38.8 %时"), (4, q)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "zh", q), (2, "zh", "要多久？")], "item_id long, lang string, question string")
    got = template_runs(docs, "doc_id", "text", items, "item_id", ["question"], lang, 40, {"zh": 16})
    assert collect(got, "doc_id", "item_id", "changed") == [(1, 1, 3), (4, 1, 0)]


def test_each_occurrence_is_judged_by_itself(spark, collect):
    p = ITEMS[0][3]
    one, two = p.replace("AG-8466", "XX-1111"), p.replace("AG-8466", "YY-2222").replace("652", "17")
    docs = [(1, p + " " + one), (2, one + " and then " + two), (3, "nothing here"), (4, p.replace("AG-8466", "BL-9990").replace("bag filter", "ink cartridge"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, passage string")
    got = template_runs(df, "doc_id", "text", items, "item_id", ["passage"], None, 70)
    assert sorted({r[0] for r in collect(got, "doc_id")}) == [1, 2]  # in 4 two names have become one


def test_one_sentence_with_other_machines_and_codes(spark, collect):
    one = "Unlike the older layout, hoist QX-2699 now vents into ink cartridge TK-5622, so an operator may wait 85 seconds."
    rest = " ".join(f"In run {k} the crew of shift {k} left everything as it had been found, {w} included." for k, w in enumerate(["oil", "fuel", "air"]))
    items = spark.createDataFrame([(1, "en", one + " " + rest)], "item_id long, lang string, passage string")
    other = one.replace("hoist QX-2699", "storage silo P-101").replace("ink cartridge TK-5622", "V-7").replace("85", "9.5")
    merged = one.replace("hoist QX-2699", "storage silo P-101").replace("ink cartridge TK-5622", "silo P-101")
    docs = [(1, "Note: " + other), (2, merged), (3, one + " " + one.replace("QX-2699", "AB-1")), (4, "nothing here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = template_runs(df, "doc_id", "text", items, "item_id", ["passage"], "lang", 50)
    assert collect(got, "doc_id", "changed") == [(1, 3), (3, 0)]  # in 2 two names have become one


def test_chinese_machine_names_of_another_length(spark, collect):
    q = "当缓冲罐 SC-1587连续68分钟处于38.8 %时，液位计 DR-8356上的哪一个示值说明班组可以放行？"
    other = q.replace("缓冲罐 SC-1587", "皮带输送机 HX-22").replace("液位计 DR-8356", "喷嘴 V-7")
    docs = spark.createDataFrame([(1, "班前会。" + other), (2, "处于38.8 %时")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "zh", q)], "item_id long, lang string, question string")
    got = template_runs(docs, "doc_id", "text", items, "item_id", ["question"], "lang", 40, {"zh": 16})
    assert collect(got, "doc_id", "changed") == [(1, 2)]
