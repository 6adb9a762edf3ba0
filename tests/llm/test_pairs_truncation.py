import random

import numpy as np
import pytest

from procgraph.llm import pairs, terminal, truncation
from procgraph.llm.terminal import open_at_end

PARTS = ["pump", "valve", "filter", "burner", "hoist"]
ROLES = ["field operator", "shift lead", "line mechanic"]


def sentence(rng):
    code = f"{rng.choice(['AG', 'BL'])}-{rng.randrange(1000, 9999)}"
    return rng.choice(
        [
            f"The {rng.choice(ROLES)} must close {rng.choice(PARTS)} {code} slowly and wait {rng.randrange(90)} minutes.",
            f"Whenever {rng.choice(PARTS)} {code} is running, the bypass stays shut.",
            f"Samples are drawn every {rng.randrange(90)} minutes and handed over to the {rng.choice(ROLES)}.",
        ]
    )


def corpus(n=600):
    rng = random.Random(9)
    ends = ["Approved: quality desk", "See also TG-41419", "- torque wrench", "| 2 | level | 5.1 kPa |", "## Shutdown", "Note: pump swapped, line back in service"]
    return [(k, "\n".join(["# Title", " ".join(sentence(rng) for _ in range(5)), sentence(rng) if k % 2 else rng.choice(ends)]), "wiki") for k in range(n)]


def test_truncation(spark):
    good = corpus()
    body = "# Title\nSamples are drawn every 5 minutes and handed over to the shift lead. "
    bad = {
        9001: body + "Whenever pump AG-1234 is runn", 9002: body + "Whenever pump AG-1234 is running, the bypass…",
        9003: body + "The shift lead must close valve", 9004: body + "Samples are drawn every", 9005: body + "Samples are dra<sp",
        9006: body + "Samples are drawn &#x2", 9007: body + "Samples are drawn \\u00", 9008: body + "Samples are drawn �",
        9009: body + "\n| 1 | level | 5.1 kPa |\n| 2 | lev", 9010: body + "<table>Samples are drawn every 5 minutes.",
        9011: body + "Samples are drawn [...]", 9012: body + "(see the drawing",
    }
    fine = {8001: None, 8002: "", 8003: " \n", 8004: body, 8005: body + "\n- torque wrench", 8006: body * 3000}
    data = good + [(k, t, "wiki") for k, t in {**bad, **fine}.items()] + [(7001, body, None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, source string, reason string").repartition(4)
    out = truncation.truncated(df, "doc_id", "text", "source")
    cut = {r.doc_id for r in out.where("reason is not null").collect()}
    assert cut == set(bad)
    shares = {r.source: (r.n_documents, r.n_truncated) for r in truncation.share_by_source(out, "source").collect()}
    assert shares == {"wiki": (len(good) + len(bad) + len(fine), len(bad)), None: (1, 0)}
    assert truncation.truncated(df.where("false"), "doc_id", "text", "source").count() == 0


def test_stack_automaton():
    assert open_at_end("<i>a</i><br/> (b) „c“ [d]") is None
    assert open_at_end("3) done") is None
    assert open_at_end("a <div><i>b</i>") == "markup"
    assert open_at_end("```code") == "markup"
    assert open_at_end("first (x\nlast [y") == "bracket"
    assert open_at_end('he said "go on') == "quote"


def test_pairs(spark):
    rng = random.Random(10)
    asked = "Who must close pump AG-1234 before restart?"
    good = [(f"g{k}", asked, " ".join(sentence(rng) for _ in range(3))) for k in range(300)]
    cases = {
        "empty": [None, "", " ​ ", "<p></p>", "N/A", "Answer:", "**", "无", "（无）", "nan"],
        "copy": [asked, "Answer: " + asked, asked + " " + asked, f'"{asked.upper()}"', asked.rstrip("?") + "."],
        "refusal": ["I'm sorry, but I cannot answer this from the given material.", "我无法根据所给材料回答。", sentence(rng) + " There is no passage I could base a reply on.",
                    "Leider darf ich hierzu keine Auskunft geben.", "Lo siento, no puedo responder con el material dado."],
        "language": ["Der Schichtleiter ist in 5 Minuten zu informieren, weil die Pumpe nicht anläuft.", "必须在五分钟内通知值班长，因为没有放行无法重启。"],
        "truncated": ["The shift lead must close valve AG-12", "Whenever pump AG-1234 is running, the byp", sentence(rng) + " The field operator must…"],
        None: ["The shift lead", "52 minutes", "11.5 kPa", "Close pump AG-1234", sentence(rng).rstrip("."), sentence(rng) + ' The panel shows "泵已就绪，请等待放行".',
               "The operator is not permitted to go on unless pump AG-1234 is safe.", asked + " The shift lead must close pump AG-1234 slowly and wait 5 minutes."],
    }
    data = good + [(f"{kind}{n}", asked, a) for kind, v in cases.items() for n, a in enumerate(v)] + [("nq", None, "The shift lead"), ("g0", *good[0][1:])]
    df = spark.createDataFrame([("t", *r) for r in data], "pair_table string, pair_id string, question string, answer string").repartition(4)
    got = {r.pair_id: r.defect for r in pairs.judged_pairs(df).collect()}
    want = {f"{kind}{n}": kind for kind, v in cases.items() for n in range(len(v))} | {"nq": None} | {g[0]: None for g in good}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(want)
    assert pairs.judged_pairs(df.where("false")).count() == 0


def test_words_and_baselines_are_counted_over_all_texts(spark):
    # A baseline counts all lines but a text's last, by source and kind of line.
    rows = [(k, "The operator opens the discharge valve after the test.\nDone", "a" if k % 2 else "b") for k in range(60)]
    rows += [(100 + k, f"Text number {k} names the word{chr(97 + k % 26)}{chr(97 + k // 26)}\nand it ends with the dischar", "a") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = terminal.fit(df, "text", "source", fit_rows=1)
    assert model.get("b", "a", "plain") == (30, 70) and model.get("b", "b", "plain") == (30, 30)
    assert model.get("p", "dischar")[1] == 60 and model.get("w", "dischar") == (0, 0)
    assert model.cut_word("dischar")


def test_a_word_that_only_ends_texts_is_whole(spark):
    rows = [(k, f"Valve {k} was opened.\nApproved: quality desk", "a") for k in range(60)]
    rows += [(100 + k, "The desktop of the operator is cleaned.", "a") for k in range(5)]
    model = terminal.fit(spark.createDataFrame(rows, "doc_id long, text string, source string"), "text", "source", fit_rows=1)
    assert not model.cut_word("desk")


def _model(texts, sources):
    f, g = terminal.frequencies(texts, sources), terminal.evidence(texts)
    rows = {}
    for t in (f, g):
        for k, e, a in zip(t["k"].tolist(), t["e"].tolist(), t["a"].tolist()):
            old = rows.get(k, (0, 0))
            rows[k] = (old[0] + e, old[1] + a)
    return terminal.Model(*(np.array(x, np.int64) for x in (list(rows), [e for e, _ in rows.values()], [a for _, a in rows.values()])))


def test_automaton_finds_what_is_open():
    open_, whole = terminal.open_at_end, None
    assert open_("Start. <b>Check the pump.") == "markup" and open_("A <!-- note.") == "markup"
    assert open_("Run it:\n```\nx = 1.") == "markup" and open_("Run:\n```\nx\n```\nDone.") is whole
    assert open_('{"a": [1, 2, {"b": "x"}') == "bracket" and open_('{"a": "not ended.') == "quote"
    assert open_('{"a": "braces } and \\\\" in it", "c": []}') is whole
    assert open_("He said: “stop the pump.") == "quote" and open_("He said: “stop” twice.") is whole
    assert open_("Er rief „halt“ und ging.") is whole and open_("Er rief „halt und ging.") == "quote"
    assert open_('The 5" pipe is "blue (see below.') in ("bracket", "quote")
    assert open_("a) first\nb) second (left)") is whole
    assert open_("One (of two\nlines.") == "bracket" and open_("Old ( mark.\n\nNew paragraph.") is whole


def test_structure_and_baseline_each_find_rows_that_nothing_else_finds():
    """Every last line is new to the model and ends in a whole, common word, so
    neither contexts nor word beginnings can tell."""
    strict = [f"Clean part {k} of it slowly. Wait for sign {k}.\n1. Close it after part {k}.\nDone with part {k} now. All is well." for k in range(60)]
    loose = [f"clean part {k} of it slowly. wait for sign {k}\n1. close it after part {k}\ndone with part {k} now. all is well" for k in range(60)]
    m = _model(strict + loose, ["strict"] * 60 + ["loose"] * 60)
    last = "Sign {k} stands at part. Zebra crossings follow it slowly"
    assert terminal.breaks_off(last, m, "strict") == "terminator"
    assert terminal.breaks_off(last, m, "loose") is None
    assert terminal.breaks_off(last + ".", m, "strict") is None
    assert terminal.breaks_off("1. zebra crossings close it", m, "strict") == "terminator"
    assert terminal.breaks_off("1. zebra crossings close it", m, "loose") is None
    for text, why in [("See <i>part of it.", "markup"), ("Part (of it.", "bracket"), ("It said “part of it.", "quote"), ("Part of it\\\\u00", "escape"),
                      ("Part of it Ã", "escape"), ("Part of it �", "mark"), ("| a | b |\n| c", "row"), ("One part.\n2.", "list")]:
        assert terminal.breaks_off(text, m, "loose") == why, text


REFUSED = [
    "I would rather not comment on that.", "That lies outside my remit, I'm afraid, so no answer from me.", "I won't be able to advise you here.",
    "The excerpts do not contain an answer to this.", "As a language model I lack access to such details.", "Dazu möchte ich mich nicht äußern.",
    "Leider liegen mir keine Informationen vor.", "Eine Empfehlung kann ich ohne Unterlagen nicht geben.", "No estoy en condiciones de responder.",
    "Prefiero no opinar sobre esto.", "Sin más contexto me resulta imposible dar una respuesta.", "这个问题我不便评论。", "恕我无法提供相关资料。", "我缺少判断所需的依据。",
]
ANSWERED = [
    "Let me answer in two steps: close valve V-12, then open V-13.", "If I do not have any alarm on the panel, I open the bypass.",
    "The valve must not be opened without a permit.", "Do not reply to alarms before the pump stops.", "No information label is needed on the valve.",
    "Der Bediener darf ohne Unterlagen nicht antworten.", "Wenn ich keine Auskunft habe, schließe ich das Ventil.", "El operador no puede parar la bomba.",
    "如果我没有收到信息，泵必须停。", "未经许可不得打开阀门。", "V-12", "none of the two valves",
]


@pytest.mark.parametrize("text", REFUSED)
def test_unseen_wordings_of_refusals(text):
    assert pairs.declines(text) and pairs.declines("Close valve V-12 first. Open V-13. " + text)


@pytest.mark.parametrize("text", ANSWERED)
def test_answers_that_look_like_refusals(text):
    assert not pairs.declines(text)


def test_compression_finds_near_copies_but_no_answers():
    q = "How far must the valve be opened before the pump starts?"
    for copy in [q, q.upper(), f'"{q}"', q + " " + q, "You asked: " + q, "How far has the valve to be opened before the pump starts?"]:
        assert pairs.is_copy(q, copy), copy
    for said in [q + " Yes.", q + " 12 mm.", "The valve must be opened 12 mm before the pump starts.", "How far must the pump be opened before the valve starts?", "before the pump starts", "valve"]:
        assert not pairs.is_copy(q, said), said
    assert pairs.is_copy("重启之后的下一步是什么？", "请问重启之后的下一步是什么") and not pairs.is_copy("重启之后的下一步是什么？", "重启之后的下一步是排空")
    assert pairs.is_copy("Why?", "why") and not pairs.is_copy("Why?", "whyever")


def test_repeated_keys_count_once(spark, collect):
    rows = [("a", "1", "Why?", "no idea at all"), ("a", "1", "Why?", "no idea at all"), ("a", "2", "Q one is this?", None), ("a", "2", "Q one is this?", "Zero bar."),
            ("b", "1", None, "x"), ("b", "3", None, None)]
    df = spark.createDataFrame(rows, "pair_table string, pair_id string, question string, answer string")
    got = collect(pairs.judged_pairs(df), "pair_table", "pair_id", "defect")
    assert got == [("a", "1", None), ("a", "2", "empty"), ("b", "1", None), ("b", "3", "empty")]
    assert pairs.judged_pairs(df.where("false")).count() == 0


CASING = "The crew inspects the boiler casing before"
FILLER = "concat('Pump ', id, ' is tested twice. Valve ', id, ' is shut.')"


def test_contexts_are_counted_over_all_pairs(spark):
    # Three of 40,004 pairs show how the sentence goes on; a sample of 10,000 pairs misses some.
    few = [("t", f"w{k}", f"What is done on day {k}?", CASING + " dawn.") for k in range(3)] + [("t", "cut", "What is done?", CASING)]
    schema = "pair_table string, pair_id string, question string, answer string"
    many = spark.range(40_000).selectExpr("'t' pair_table", "cast(id as string) pair_id", "'Which pump?' question", FILLER + " answer")
    got = pairs.judged_pairs(many.unionByName(spark.createDataFrame(few, schema))).where("defect is not null").collect()
    assert [(r.pair_id, r.defect) for r in got] == [("cut", "truncated")]


def test_model_has_all_asked_contexts_and_first_words(spark):
    # Every passage is read one by one; several blocks of texts and tasks are added up.
    texts = [t for _, t, _ in corpus(300)] + ["Samples are drawn every", "Wait 5.", "Whenever pump AG-1 is", "泵已就绪，请等待", "", " ", None]
    seen = {}

    def add(k, end):
        e, a = seen.get(k, (0, 0))
        seen[k] = (e + end, a + 1)

    for text in filter(None, texts):
        for passage, stop, inner in terminal.passages(text):
            t = terminal.tokens(passage.rstrip(terminal.CLOSERS + " ").rstrip(terminal.STOPS) if stop else passage)
            for n in terminal.STARTS if t else ():
                if n <= len(t) or n == terminal.STARTS[-1]:
                    add(terminal.start_key(t[:n]), stop)
            for i in range(1, len(t) + (stop or inner)):
                for n in terminal.ORDERS:
                    add(terminal.context_key([terminal.BEGIN, *t[:i]], n), i == len(t))
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    model = terminal.fit(df, "t")
    asked = {k for t in texts for k in terminal.asked_keys(t)}
    want = {k: seen[k] for k in asked if seen.get(k, (0, 0))[1] >= terminal.LEAST_SEEN}
    assert len(want) > 20 and {k: model.at(k) for k in want} == want
    assert all(model.at(k) == (0, 0) for k in seen.keys() - want.keys())


def test_cut_marks_show_no_ends():
    assert terminal.passages("Valve shut. Any leak found at...") == [("Valve shut.", True, True), ("Any leak found at...", False, False)]
    assert terminal.passages("Any leak found at [...]")[-1][1] is False
    # One text with a mark must not make the same cut passage without it a complete one.
    texts = [f"Any leak found at pump {k} is stopped." for k in range(9)] + ["Any leak found at..."]
    assert terminal.breaks_off("Any leak found at", _model(texts, ["a"] * 10), "a") == "sentence"


def test_contexts_are_counted_over_all_documents(spark):
    # Three of 40,004 documents show how the sentence goes on; a sample of 10,000 documents misses some.
    few = [(-1 - k, CASING + " dawn.", "wiki") for k in range(3)] + [(-9, CASING, "wiki")]
    many = spark.range(40_000).selectExpr("id doc_id", FILLER + " text", "'wiki' source")
    df = many.unionByName(spark.createDataFrame(few, "doc_id long, text string, source string"))
    got = truncation.truncated(df, "doc_id", "text", "source").where("reason is not null").collect()
    assert [(r.doc_id, r.reason) for r in got] == [(-9, "sentence")]
