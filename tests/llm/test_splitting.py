import string

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from procgraph.llm.splitting import BOUNDARIES, split_oversized, split_points

CLUSTERED = "a👷‍♀️é⚠️🇩🇪 b.\n"


def check(text, limit, overlap):
    spans = split_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - c == overlap and d > b
    assert all(0 < b - a <= limit for a, b in spans)
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=string.ascii_letters[:4] + " .\n,。" + CLUSTERED, min_size=1, max_size=900), st.integers(30, 120))
def test_limits_and_overlap_hold(text, limit):
    check(text, limit, limit // 5)


def test_cuts_at_paragraphs_before_words():
    para = "word " * 86
    text = "\n\n".join(para.strip() for _ in range(6))
    for _, end in check(text, 500, 50)[:-1]:
        assert text[:end].endswith("\n\n")


def test_unbroken_text_is_balanced_and_clusters_stay_whole():
    sizes = [b - a for a, b in check("x" * 2600, 500, 50)]
    assert max(sizes) - min(sizes) <= 2
    text = "👷‍♀️" * 300
    starts = {m.start() for m in regex.finditer(r"\X", text)}
    assert all(end in starts for _, end in check(text, 500, 48)[:-1])


def test_very_long_text_is_split_whole():
    text = ("The valve is opened slowly. " * 20_000).strip()
    assert len(check(text, 500, 50)) >= len(text) // 450


def test_operator(spark):
    long, other = "Open the valve. " * 50, "y" * 700
    data = [
        ("a", long, 1, "x"), ("a", long, 2, "x"), ("b", "short", 1, "x"), ("c", None, 1, "x"), ("d", " \n\t", 1, None),
        ("e", "  " + "z" * 500 + "\r\n ", 1, "x"), ("f", "z" * 501, 1, "x"), (None, other, 1, "x"),
    ]
    df = spark.createDataFrame(data, "id string, text string, version int, piece string")
    out = split_oversized(df, "id", "text", version="version").collect()
    assert {r.id for r in out} == {"a", "f", None}
    pieces = sorted((r.piece_index, r.piece) for r in out if r.id == "a")
    joined = pieces[0][1] + "".join(p[50:] for _, p in pieces[1:])
    assert joined == long.strip(" \t\r\n") and all(len(p) <= 500 for _, p in pieces)
    assert split_oversized(df.where("false"), "id", "text").count() == 0


def hard_cuts(text, limit, overlap):
    """Cuts at no boundary although one lies where the piece could have ended."""
    ends = {m.end() for p in BOUNDARIES for m in p.finditer(text)}
    spans = check(text, limit, overlap)[:-1]
    return [(a, b) for a, b in spans if b not in ends and any(a + overlap < e <= a + limit for e in ends)]


def test_a_piece_more_rather_than_a_cut_inside_a_word():
    text = "Overheating bearings shorten maintenance intervals considerably. " * 40
    for n in [*range(501, 520), 940, 948, 950, 1397, 1398, 1399, 1400, 1850, 2300]:
        assert not hard_cuts(text[:n], 500, 50)
    assert len(check("x" * 1400, 500, 50)) == 3  # without boundaries the least number stays


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdef ", min_size=1, max_size=900), st.integers(30, 120))
def test_words_stay_whole_where_they_can(text, limit):
    assert not hard_cuts(text, limit, limit // 5)
