"""Evaluation texts leaking into training text (problem 9).

Method: template canonicalisation.  Texts are folded to letters and digits;
numbers (and for re-parameterised copies names and units too) become typed
placeholders; hashes of template windows are joined with those of the held-out
items; and a candidate must have consistent slots.  Equal slots are extended to
the whole shared run, which is compared character by character (`leaked_runs`);
slots that map one to one onto other values are a re-parameterised copy
(`template_runs`).

For runs every digit has a placeholder of its own, so that a template is as long
as its text and a run may begin and end inside a number.  An item has a window
at each place; of a document only every step-th window is looked up, with a step
so small that each run that is long enough holds one.

The held-out items are small as a rule: their windows travel as one broadcast,
checked against MAX_ITEM_CHARS, and the corpus is read once and never shuffled.
Beyond that the windows of both sides are joined by a shuffle, and templates go
in several broadcasts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import filled
from .pairs import FUNCTION
from .terminal import CJK

#: More held-out text than this is not broadcast at once.
MAX_ITEM_CHARS = 4_000_000

TAG = re.compile(r"<[^<>]*>")
OTHER = re.compile(r"[\W_]+")

SEPARATOR, NAME, QUANTITY = 1, 2, 3  # codes that folded text can't contain
_ODD = 0x9E3779B97F4A7C15 | 1
_BITS = 22
BLOCK_CHARS = 1_500_000

# Symbols of units, as they look in lower case.
UNIT_PREFIXES = "da y z a f p n µ μ m c d h k g t".split()
UNIT_BASES = (
    "m g s a k mol cd hz n pa j w c v f ω wb t h lm lx bq gy sv kat l bar ev wh va ah b bit byte cal eq gauss "
    "min d rpm ppm ppb psi ft in lb oz gal mph kn hp db ph st mil "
    "°c °f °k ° ℃ % ‰ sec std stk uhr tage tag días día horas hora minutos minuten stunden sekunden hours hour minutes "
    "minute seconds second days day"
).split()
_UNIT = "(?:(?:" + "|".join(UNIT_PREFIXES) + ")?(?:" + "|".join(sorted(map(re.escape, UNIT_BASES), key=len, reverse=True)) + ")[²³23]?)"

#: A code or a number with its unit, in NFKC and lower case.
SLOT = re.compile(
    r"(?P<code>(?<![a-z0-9])(?:[a-z]{1,6}[-_/.]?\d+(?:[-_/.]?[a-z0-9]{1,6})?|[a-z]{2}[\W_]{0,2}\d{4})(?![a-z0-9]))"
    rf"|\d+(?:[.,]\d+)*(?:\s*{_UNIT}(?:\s?/\s?{_UNIT})?(?![a-zµμ]))?"
)
CLAUSE = re.compile(r"[.,;:!?()|。，；：、！？（）]")
WORD = re.compile(rf"[{CJK}]+|(?:(?![{CJK}])[^\W\d_])+")
#: Words and characters that are no part of a name; "de" may join two words of one.
NO_NAME = (FUNCTION | frozenset("as so than has had no one now into until nobody while once over as como tras si".split())) - {"de"}
NO_NAME_CJK = re.compile("[给和把到有当中由在与对从使让是的向往将被用而只要若如]")
TEMPLATE = re.compile(r"[^\w\x02\x03]|_")


def template(text: str) -> tuple[str, list[str], list[str]]:
    """The text folded with NAME or QUANTITY for each slot; the slots' values (of
    a name only its code) and whole texts."""
    text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = TAG.sub("", text)
    text = text.lower().replace("\x02", " ").replace("\x03", " ")
    out, values, slots, done = [], [], [], 0
    for m in SLOT.finditer(text):
        begin, is_name = m.start(), m["code"] is not None
        if is_name:
            cut = done
            for c in CLAUSE.finditer(text, done, begin):
                cut = c.end()
            for w in reversed(list(WORD.finditer(text, cut, begin))):
                if "\u3040" <= w[0][0]:
                    last = max((c.end() for c in NO_NAME_CJK.finditer(w[0])), default=0)
                    begin = w.start() + last if last < len(w[0]) else begin
                    if last:
                        break
                elif w[0] in NO_NAME:
                    break
                else:
                    begin = w.start()
        out += [text[done:begin], chr(NAME if is_name else QUANTITY)]
        values.append(OTHER.sub("", m[0]) if is_name else re.sub(r"\s", "", m[0]))
        slots.append(re.sub(r"[\W_]+", "", text[begin : m.end()]) if is_name else values[-1])
        done = m.end()
    return TEMPLATE.sub("", "".join([*out, text[done:]])), values, slots


class Templates:
    """Templates end to end and their rolling hashes; every character is a token."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("\x01".join(texts + [""]).encode("utf-32-le"), np.uint32)
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.slot = (code == NAME) | (code == QUANTITY)
        self.separator = code == SEPARATOR
        up, self.down = powers(len(code) + 1)
        with np.errstate(over="ignore"):
            self._code = np.concatenate([[np.uint64(0)], np.cumsum(code.astype(np.uint64) * up[: len(code)])])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of width tokens that lie within one text."""
        past = np.concatenate([[0], np.cumsum(self.separator)])
        i = np.arange(max(0, len(self.separator) - width + 1))
        i = i[past[i + width] == past[i]]
        with np.errstate(over="ignore"):
            return i, mixed((self._code[i + width] - self._code[i]) * self.down[i] + np.uint64(width))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1


def fold(text: str) -> str:
    """NFKC, without markup tags, lower case, letters and digits only."""
    text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = TAG.sub("", text)
    return OTHER.sub("", text.lower())


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i below n."""
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def digits_masked(raw: np.ndarray) -> np.ndarray:
    """Character codes with the placeholder QUANTITY for every digit."""
    code = raw.astype(np.uint64)
    code[(raw >= 48) & (raw <= 57)] = QUANTITY
    return code


class Folded:
    """Folded texts end to end and the rolling hashes of their templates and slots."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        raw = np.frombuffer("\x01".join(texts + [""]).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 1)]).astype(np.int64)
        up, self.down = powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self._template = np.concatenate([[np.uint64(0)], np.cumsum(digits_masked(raw) * up[:-1])])
            self._raw = np.concatenate([[np.uint64(0)], np.cumsum(raw.astype(np.uint64) * up[:-1])])

    def starts(self, width: int, step: int = 1) -> np.ndarray:
        """Every step-th window start of each text; windows lie within one text."""
        counts = np.maximum(0, (self.sizes - width) // step + 1)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.repeat(self.begins[:-1] - first * step, counts) + np.arange(int(counts.sum())) * step

    def template_hash(self, i: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self._template[i + width] - self._template[i]) * self.down[i] + np.uint64(width))

    def window_hash(self, i: np.ndarray, width: int, template: np.ndarray) -> np.ndarray:
        """Template and slot values together."""
        with np.errstate(over="ignore"):
            slots = (self._raw[i + width] - self._raw[i]) * self.down[i]
        return mixed(template ^ mixed(slots + np.uint64(7)))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1


def window_of(run: int) -> tuple[int, int]:
    """Width and step: a run of that many characters holds a whole window that
    starts at a multiple of the step, wherever the run begins."""
    width = max(1, 2 * run // 3)
    return width, run - width + 1


class Index:
    """Template windows of the held-out texts."""

    def __init__(self, texts: list[str], runs: list[int]):
        self.texts, self.need = texts, np.array(runs, np.int64)
        folded = Folded(texts)
        self.begins = folded.begins
        self.levels = []
        for run in sorted(set(runs)):
            width, step = window_of(run)
            i = folded.starts(width)
            i = i[self.need[folded.text_of(i)] == run]
            template = folded.template_hash(i, width)
            both = folded.window_hash(i, width, template)
            order = np.argsort(both, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[template >> np.uint64(64 - _BITS)] = True
            self.levels.append((width, step, seen, np.unique(template), both[order], i[order]))

    def runs_in(self, docs: Folded) -> list[tuple[int, int, int, int, int]]:
        """(document, text, start in the document, length, start in the text) of
        shared runs that are as long as the text needs."""
        out = []
        for width, step, seen, templates, both, at in self.levels:
            i = docs.starts(width, step)
            template = docs.template_hash(i, width)
            near = seen[template >> np.uint64(64 - _BITS)]
            i, template = i[near], template[near]
            hit = templates[np.minimum(np.searchsorted(templates, template), len(templates) - 1)] == template
            i, template = i[hit], template[hit]
            if not len(i):
                continue
            pair = docs.window_hash(i, width, template)  # the slots must be equal too
            low, times = np.searchsorted(both, pair, "left"), 0
            times = np.searchsorted(both, pair, "right") - low
            if not times.sum():
                continue
            which = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            mine, theirs = at[which], np.repeat(i, times)
            text, doc = np.searchsorted(self.begins, mine, "right") - 1, docs.text_of(theirs)
            mine, theirs = mine - self.begins[text], theirs - docs.begins[doc]
            keys = np.stack([doc, text, theirs - mine, theirs], 1)
            reached: dict[tuple[int, int, int], int] = {}
            for d, t, diagonal, p in keys[np.lexsort(keys.T[::-1])].tolist():
                if reached.get((d, t, diagonal), -1) > p:
                    continue
                a, b = extend(docs.texts[d], self.texts[t], p, p - diagonal)
                reached[d, t, diagonal] = b
                if b - a >= self.need[t]:
                    out.append((d, t, a, b - a, a - diagonal))
        return out


def blocks(texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in blocks of about BLOCK_CHARS characters: (numbers, offsets, pieces).
    A longer text comes in pieces that share overlap characters, so memory does
    not depend on the length of a text."""
    numbers, offsets, pieces, size = [], [], [], 0
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t) - overlap), BLOCK_CHARS):
            piece = t[at : at + BLOCK_CHARS + overlap] if len(t) > BLOCK_CHARS else t
            if size and size + len(piece) > BLOCK_CHARS:
                yield numbers, offsets, pieces
                numbers, offsets, pieces, size = [], [], [], 0
            numbers.append(n)
            offsets.append(at)
            pieces.append(piece)
            size += len(piece)
            if len(t) <= BLOCK_CHARS:
                break
    if pieces:
        yield numbers, offsets, pieces


def extend(doc: str, text: str, p: int, q: int) -> tuple[int, int]:
    """Ends in doc of the longest equal run of doc and text around doc[p], text[q]."""
    a, b, c, d = p, q, p, q
    while a and b and doc[a - 1] == text[b - 1]:
        a, b = a - 1, b - 1
    while c < len(doc) and d < len(text) and doc[c] == text[d]:
        c, d = c + 1, d + 1
    return a, c


def too_large(items: DataFrame, texts: list[str]) -> int:
    """How often the held-out texts exceed MAX_ITEM_CHARS, at least 1."""
    chars = sum((F.coalesce(F.length(F.col(f"`{t}`")), F.lit(0)) for t in texts), F.lit(0))
    return max(1, -(-(items.agg(F.sum(chars)).first()[0] or 0) // MAX_ITEM_CHARS))


def held_out(items: DataFrame, key: str, texts: list[str], lang: str | None) -> list[tuple]:
    """Rows of a held-out table whose size has been checked."""
    cols = [F.col(f"`{key}`"), F.col(f"`{lang}`") if lang else F.lit(None).cast("string"), *[F.col(f"`{t}`") for t in texts]]
    return [tuple(r) for r in items.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).distinct().collect()]


def needed(lang: str | None, default: int, by_lang: dict[str, int] | None) -> int:
    return (by_lang or {}).get((lang or "").strip().lower(), default)


def leaked_runs(
    docs: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_texts: list[str],
    item_lang: str | None = None,
    run: int = 60,
    run_by_lang: dict[str, int] | None = None,
) -> DataFrame:
    """(key, item key, part, start, length): unbroken runs of at least run folded
    characters that a document shares with a text of an item.  start counts in
    the folded document.  Items in a language of run_by_lang need that many.

    Null and empty texts share nothing; texts of an item shorter than its run
    cannot leak.  Repeated documents or items give rows of their own; where the
    items are too large for a broadcast, fully repeated documents count once.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, part string, start long, length long"
    corpus = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    if too_large(items, item_texts) > 1:
        parts = [
            items.select(
                F.col(f"`{item_key}`").alias("item"),
                (F.lower(F.trim(F.col(f"`{item_lang}`"))) if item_lang else F.lit(None).cast("string")).alias("lang"),
                F.lit(x).alias("part"),
                F.col(f"`{x}`").alias("own"),
            )
            for x in item_texts
        ]
        own = parts[0]
        for x in parts[1:]:
            own = own.unionByName(x)
        return _joined_runs(corpus, own, kinds, run, run_by_lang or {}).toDF(key, item_key, "part", "start", "length")
    owners, folded, needs = [], [], []
    for item, lang, *parts in held_out(items, item_key, item_texts, item_lang):
        need = needed(lang, run, run_by_lang)
        for name, part in zip(item_texts, parts):
            t = fold(part or "")
            if len(t) >= need:
                owners.append((item, name))
                folded.append(t)
                needs.append(need)
    if not folded:
        return docs.sparkSession.createDataFrame([], schema)
    index = docs.sparkSession.sparkContext.broadcast(Index(folded, needs))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["k"].tolist()
            texts = [fold(t) if t else "" for t in pdf["t"]]
            found = set()  # a run over the border of two pieces is extended to the same whole run
            for numbers, offsets, pieces in blocks(texts, max(map(len, folded)) + 100):
                for d, t, a, _, q in index.value.runs_in(Folded(pieces)):
                    n, a = numbers[d], a + offsets[d]
                    a, b = extend(texts[n], index.value.texts[t], a, q)
                    found.add((n, t, a, b - a))
            yield pd.DataFrame(
                [(ids[n], *owners[t], a, size) for n, t, a, size in sorted(found)],
                columns=[key, item_key, "part", "start", "length"],
            )

    return corpus.mapInPandas(filled(scan), schema)


def _joined_runs(corpus: DataFrame, own: DataFrame, kinds: tuple[str, str], run: int, by_lang: dict[str, int]) -> DataFrame:
    """leaked_runs with a shuffle hash join of the windows of both sides; the texts
    come back only for the pairs that share a window."""
    runs = sorted({run, *by_lang.values()})
    lookup = F.coalesce(*[F.when(F.col("lang") == k, F.lit(n)) for k, n in by_lang.items()], F.lit(run))
    own = own.where("own is not null").withColumn("need", lookup).drop("lang").distinct()
    corpus = corpus.where("t is not null").withColumn("th", F.xxhash64("t")).dropDuplicates(["k", "th"])

    def hashes(texts: list[str], widths) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        for numbers, offsets, pieces in blocks(texts, 2 * runs[-1]):
            f = Folded(pieces)
            for width, step, need in widths:
                i = f.starts(width, step)
                d = f.text_of(i)
                h = f.window_hash(i, width, f.template_hash(i, width)).astype(np.int64)
                yield np.array(numbers)[d], i - f.begins[d] + np.array(offsets)[d], h, need

    def doc_windows(batches):
        for pdf in batches:
            for n, at, h, need in hashes([fold(t) for t in pdf["t"]], [(*window_of(r), r) for r in runs]):
                yield pdf[["k", "th"]].iloc[n].assign(p=at, h=h, need=need)

    def own_windows(batches):
        for pdf in batches:
            for need, some in pdf.groupby("need"):
                for n, at, h, _ in hashes([fold(t) for t in some["own"]], [(window_of(need)[0], 1, need)]):
                    yield some[["item", "part", "need"]].iloc[n].assign(q=at, h=h)

    left = corpus.mapInPandas(filled(doc_windows), f"k {kinds[0]}, th long, p long, h long, need int")
    right = own.mapInPandas(filled(own_windows), f"item {kinds[1]}, part string, need int, q long, h long")
    near = left.join(right, ["h", "need"]).groupBy("k", "th", "item", "part", "need", (F.col("p") - F.col("q")).alias("shift"))
    near = near.agg(F.sort_array(F.collect_set("p")).alias("p"))  # no more than the item has windows
    pairs = near.join(corpus, ["k", "th"]).join(own, ["item", "part", "need"])

    def verify(batches):
        for pdf in batches:
            rows = []
            for k, item, part, need, shift, places, t, o in zip(*(pdf[c] for c in ("k", "item", "part", "need", "shift", "p", "t", "own"))):
                t, o, reached = fold(t), fold(o), -1
                for p in places:
                    # Another version of the item may own the window.
                    if p < reached or not 0 <= p - shift < len(o) or t[p] != o[p - shift]:
                        continue
                    a, reached = extend(t, o, p, p - shift)
                    if reached - a >= need:
                        rows.append((k, item, part, a, reached - a))
            yield pd.DataFrame(rows, columns=["k", "item", "part", "start", "length"])

    schema = f"k {kinds[0]}, item {kinds[1]}, part string, start long, length long"
    return pairs.select("k", "item", "part", "need", "shift", "p", "t", "own").mapInPandas(filled(verify), schema)


def template_runs(
    docs: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_texts: list[str],
    item_lang: str | None = None,
    tokens: int = 40,
    tokens_by_lang: dict[str, int] | None = None,
) -> DataFrame:
    """(key, item key, part, windows, changed): documents that hold at least tokens
    template characters of an item's text in one run, in whole or in part, with
    slots that map one to one onto other values.

    windows counts those of the longest such run, changed its differing slots; 0
    means equal values.  Items in a language of tokens_by_lang need that many; of
    a shorter template all.  Texts of nothing but slots are left out.  Held-out
    texts beyond MAX_ITEM_CHARS are taken in parts, each in a scan of its own.
    """
    times = too_large(items, item_texts)
    part = F.pmod(F.xxhash64(F.col(f"`{item_key}`")), F.lit(times))
    out = None
    for n in range(times):
        some = items if times == 1 else items.where(part == n)
        found = _template_runs(docs, key, text, some, item_key, item_texts, item_lang, tokens, tokens_by_lang)
        out = found if out is None else out.unionByName(found)
    return out


def _template_runs(docs, key, text, items, item_key, item_texts, item_lang, tokens, tokens_by_lang) -> DataFrame:
    owners, known, needs = [], [], []
    for item, lang, *parts in held_out(items, item_key, item_texts, item_lang):
        need = needed(lang, tokens, tokens_by_lang)
        for name, part in zip(item_texts, parts):
            t = template(part or "")
            if t[0].strip("\x02\x03"):
                owners.append((item, name))
                known.append(t)
                needs.append(min(need, len(t[0])))
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, part string, windows long, changed long"
    if not known:
        return docs.sparkSession.createDataFrame([], schema)
    joined, need = Templates([t for t, _, _ in known]), np.array(needs, np.int64)
    levels = []
    for width in sorted(set(needs)):
        i, h = joined.windows(width)
        keep = need[joined.text_of(i)] == width
        i, h = i[keep], h[keep]
        order = np.argsort(h, kind="stable")
        levels.append((width, h[order], i[order]))
    shared = docs.sparkSession.sparkContext.broadcast((known, joined.begins, levels))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, begins, levels = shared.value
        filters = []
        for _, hashes, _ in levels:
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes >> np.uint64(64 - _BITS)] = True
            filters.append(seen)
        places = [slot_places(t) for t, _, _ in known]
        longest = max(len(t) for t, _, _ in known) + 100
        for pdf in batches:
            ids = pdf["k"].tolist()
            theirs = [template(t) if t else ("", [], []) for t in pdf["t"]]
            slots_of: dict[int, np.ndarray] = {}
            rows: dict[tuple[int, int], tuple[int, int]] = {}
            for numbers, offsets, pieces in blocks([t for t, _, _ in theirs], longest):
                here = Templates(pieces)
                for (width, hashes, at), seen in zip(levels, filters):
                    i, h = here.windows(width)
                    near = seen[h >> np.uint64(64 - _BITS)]
                    i, h = i[near], h[near]
                    a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    times = b - a
                    if not times.sum():
                        continue
                    m = at[np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]
                    p = np.repeat(i, times)
                    order = np.lexsort((p, p - m))
                    m, p = m[order], p[order]
                    d, t = here.text_of(p), np.searchsorted(begins, m, "right") - 1
                    new = np.flatnonzero((np.diff(m) != 1) | (np.diff(p) != 1) | (np.diff(t) != 0) | (np.diff(d) != 0)) + 1
                    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(m)]]) - 1
                    for f, z in zip(first.tolist(), last.tolist()):
                        n, k = numbers[d[f]], int(t[f])
                        if n not in slots_of:
                            slots_of[n] = slot_places(theirs[n][0])
                        q, o = int(m[f] - begins[k]), int(p[f] - here.begins[d[f]]) + offsets[d[f]]
                        size = int(m[z] - m[f]) + width
                        found = consistent(known[k], places[k], q, theirs[n], slots_of[n], o, size, width)
                        old = rows.get((n, k), (0, 0))
                        if found and (found[0], -found[1]) > (old[0], -old[1]):
                            rows[n, k] = found
            yield pd.DataFrame(
                [(ids[n], *owners[t], *found) for (n, t), found in rows.items()],
                columns=[key, item_key, "part", "windows", "changed"],
            )

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInPandas(filled(scan), schema)


def slot_places(t: str) -> np.ndarray:
    """Places of the slots in a template."""
    return np.array([i for i, c in enumerate(t) if c in "\x02\x03"], np.int64)


def consistent(known, mine, q: int, doc, theirs, o: int, size: int, width: int) -> tuple[int, int] | None:
    """(windows, changed) of the longest stretch of equal templates known[q:q+size]
    and doc[o:o+size] whose slots map one to one, if it holds a window."""
    a, b = np.searchsorted(mine, q), np.searchsorted(mine, q + size)
    c = int(np.searchsorted(theirs, o))
    there: dict[str, tuple[str, int]] = {}
    back: dict[str, tuple[str, int]] = {}
    best, begin, changed = None, 0, []
    for k, place in enumerate((mine[a:b] - q).tolist()):
        x, y = known[1][a + k], doc[1][c + k]
        clash = -1  # the last slot that this one contradicts
        for left, right, seen in ((x, y, there), (y, x, back)):
            if left in seen and seen[left][0] != right:
                clash = max(clash, seen[left][1])
        if clash >= begin:
            best = longer(best, begin, place, width, changed)
            begin = clash + 1
        there[x], back[y] = (y, place), (x, place)
        if known[2][a + k] != doc[2][c + k]:
            changed.append(place)
    return longer(best, begin, size, width, changed)


def longer(best, begin: int, end: int, width: int, changed: list[int]) -> tuple[int, int] | None:
    if end - begin < width or best and best[0] >= end - begin - width + 1:
        return best
    return end - begin - width + 1, sum(begin <= p < end for p in changed)
