"""Does a text end where texts end, or was it cut?

Structure comes first.  A stack automaton reads the whole text and tells what is
still open at its end.  Every line is a unit of some kind (paragraph, line,
numbered step, bullet, label, table row); for each source and kind the share of
units that end with a terminator is counted over all texts.  Where nearly all
do, a last unit without one was cut; where nearly none do, it is complete.

Kinds whose units end either way are decided by terminal contexts, a model
fitted without labels.  Inside a text every sentence end and line end shows how
complete passages end, and every other position shows how they do not; so for
the last tokens of a text the share of ends among all inner occurrences of those
tokens tells whether the text breaks off.  Contexts, first words, words, word
beginnings and baselines are counted over all texts; only contexts and first
words that the end of some text asks for are kept, the others never count.  The
model is applied to every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import filled

ORDERS = (7, 4, 2, 1)
BEGIN = "\x02"
STARTS = (6, 3, 2)
END_SHARE = 0.05
#: Occurrences from which a context or first words tell anything.
LEAST_SEEN = 3
#: 64-bit words of the filter of asked contexts (16 MB); keys that collide in it are sorted out when counts are added.
SLOTS = 1 << 21
#: Texts and characters that are counted at once.
BLOCK_TEXTS, BLOCK_CHARS = 2000, 1 << 22
#: Units of a source and kind from which a baseline is taken, else all sources together count.
LEAST_UNITS = 20
#: From which share of terminated units a missing terminator is a cut, and up to which it says nothing.
MUST_STOP, NEED_NOT_STOP = 0.75, 0.02
ALL_SOURCES = "\x00"
#: A word this much rarer than longer words with the same beginning counts as cut.
CUT_RATIO = 0.01

CJK = "぀-ヿ㐀-鿿가-힯"
TOKEN = re.compile(rf"[A-Za-z]{{1,4}}-\d+|[{CJK}]|(?:(?![{CJK}])[^\W\d_])+|\d+(?:[.,]\d+)*|[^\w\s]|_")
#: The same for texts without CJK characters.
PLAIN_TOKEN = re.compile(r"[A-Za-z]{1,4}-\d+|[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]|_")
HAS_CJK = re.compile(f"[{CJK}]")
CODE = re.compile(r"[A-Za-z]{1,4}-\d+$")
MARKER = re.compile(r"(?:[>\-*•!#+]+\s+|\d+\s*[.)\-:]\s+|\d+(?:\.\d+)+\s+)+")
#: The stop that ends a sentence inside a line, and what lies before the next sentence.
SENTENCE = re.compile(r"[.!?][\"”’)]*\s+|[。！？](?=.)")
STOPS = ".!?。！？"
CLOSERS = "\"'”’」』）)]»“"


def tokens(passage: str) -> list[str]:
    """Words in lower case, single CJK characters, punctuation; numbers become 0
    and codes keep only the number of their digits."""
    return [normal(x) for x in splitter(passage)(passage)]


def splitter(text: str):
    """What splits the text, or a part of it, into raw tokens."""
    return (PLAIN_TOKEN if text.isascii() or not HAS_CJK.search(text) else TOKEN).findall


def normal(x: str) -> str:
    if x[0].isdigit():
        return "0"
    if "-" in x and CODE.match(x):
        head, _, digits = x.partition("-")
        return "@" * len(head) + "9" * len(digits)
    return x.lower()


def sentences(line: str) -> list[str]:
    """The sentences of a line, without what lies between them."""
    out, low = [], 0
    for m in SENTENCE.finditer(line):
        out.append(line[low : m.start() + 1])
        low = m.end()
    return [*out, line[low:]] if low < len(line) else out


def passages(text: str) -> list[tuple[str, bool, bool]]:
    """(passage, ends with a stop, followed by more of the text) of a text.  Dots
    that mark the end of a text as cut are no stop."""
    out = []
    lines = [x.strip() for x in text.splitlines()]
    last = max((i for i, x in enumerate(lines) if x), default=-1)
    for i, line in enumerate(lines[: last + 1]):
        if m := MARKER.match(line):
            line = line[m.end() :]
        parts = sentences(line)
        for j, p in enumerate(parts):
            inner = i < last or j < len(parts) - 1
            stop = stopped(p) and (inner or not CUT_MARK.search(p[-40:]))
            out.append((p, stop, inner))
    return out


LABELLED = re.compile(r"[^\s:：]{1,20}(?: [^\s:：]{1,20}){0,2}\s*[:：]")
NUMBERED = re.compile(r"[^\d]{0,3}\d")


def kind_of(line: str) -> str:
    """Kind of a line: row, or what it starts with and whether it holds several
    sentences."""
    if line.startswith("|"):
        return "row"
    kind = "plain"
    if m := MARKER.match(line):
        kind = "step" if NUMBERED.match(m[0]) else "bullet"
        line = line[m.end() :]
    if (m := SENTENCE.search(line)) and m.end() < len(line):
        return kind + " text"
    return kind + " label" if LABELLED.match(line) else kind


def stopped(line: str) -> bool:
    bare = line.rstrip(CLOSERS + " ")
    return bool(bare) and bare[-1] in STOPS


MASK = (1 << 64) - 1
#: Odd multipliers of the token k places before the end of a context.
PLACES = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) + (k << 33)) & MASK | 1 for k in range(max(ORDERS)))


def key(kind: str, *parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join((kind, *parts)).encode("utf-8", "replace")) >> 1


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))


def context_key(seq: list[str], order: int) -> int:
    """Key of the last order tokens of seq, which starts with BEGIN."""
    h = token_hash(f"order {order}")
    for k, t in enumerate(reversed(seq[-order:])):
        h = (h + token_hash(t) * PLACES[k]) & MASK
    return h >> 1


def start_key(t: list[str]) -> int:
    """Key of the first words t of a passage."""
    h = token_hash(f"start {len(t)}")
    for k, x in enumerate(t):
        h = (h + token_hash(x) * PLACES[k]) & MASK
    return h >> 1


def last_part(text: str) -> tuple[str, str]:
    """The last line of a text without its marker, and the passage it ends in."""
    line = text.splitlines()[-1].strip()
    body = MARKER.sub("", line, count=1) if MARKER.match(line) else line
    parts = sentences(body)
    return body, TAG.sub("", parts[-1]) if parts else ""


def visible(text: str) -> str:
    """The text without white space and invisible characters at its end."""
    return text.rstrip().rstrip("​﻿‎‏").rstrip()


def asked_keys(text: str | None) -> list[int]:
    """Keys of all contexts and first words that `breaks_off` may look up for a text."""
    shown = visible(text) if text else ""
    if not shown:
        return []
    last = last_part(shown)[1]
    bare = last.rstrip(CLOSERS + " ")
    if bare[-1:] in STOPS and bare:
        if bare[-1] != "." or not bare[:-1].rstrip()[-1:].isdigit():
            return []
        seq = [BEGIN, *tokens(bare[:-1])]
        return [context_key(seq, n) for n in ORDERS]
    seq = [BEGIN, *tokens(last)]
    if len(seq) == 1:
        return []
    return [context_key(seq, n) for n in ORDERS] + [start_key(seq[1 : n + 1]) for n in STARTS]


def asked_contexts(texts: list[str]) -> dict[str, np.ndarray]:
    return {"k": np.unique(np.array([k for t in texts for k in asked_keys(t)], np.int64))}


class Numbers(dict):
    """Numbers of tokens by their raw form, and the tokens by their numbers."""

    def __init__(self):
        self.names, self.known = [BEGIN], {BEGIN: 0}

    def __missing__(self, raw: str) -> int:
        name = normal(raw)
        n = self[raw] = self.known.setdefault(name, len(self.names))
        if n == len(self.names):
            self.names.append(name)
        return n


class Stream:
    """The passages of texts end to end, each behind a BEGIN, as numbers of tokens."""

    def __init__(self, texts: list[str]):
        number, stream, sizes, stops, whole = Numbers(), [], [], [], []
        for text in texts:
            if not text:
                continue
            split = splitter(text)
            for passage, stop, inner in passages(text):
                t = split(passage.rstrip(CLOSERS + " ").rstrip(STOPS) if stop else passage)
                if not t:
                    continue
                stream.append(0)
                stream += map(number.__getitem__, t)
                sizes.append(len(t))
                stops.append(stop)
                whole.append(stop or inner)
        self.names = number.names
        self.numbers = np.array(stream, np.int64)
        self.sizes, self.stops, self.whole = np.array(sizes, np.int64), np.array(stops, bool), np.array(whole, bool)


def frequencies(texts: list[str], sources: list[str | None], stream: Stream | None = None) -> dict[str, np.ndarray]:
    """k, e, a, asked: counts of words, word beginnings and units of sources; asked
    marks units and the words that a text ends in, the only ones that are looked
    up.  Texts without source (None) have no baseline."""
    ends: Counter = Counter()
    seen: Counter = Counter()
    last: Counter = Counter()
    words: Counter = Counter()
    for text, source in zip(texts, sources):
        if not text:
            continue
        if source is not None:
            for line in [x.strip() for x in text.splitlines() if x.strip()][:-1]:
                unit = source, kind_of(line)
                seen[unit] += 1
                ends[unit] += stopped(line)
        if shown := visible(text):
            end = last_part(shown)[1]
            if t := splitter(end)(end):
                word = normal(t[-1])
                last[word] += 1
                if not stopped(end):
                    words[word] -= 1  # it may be cut
    for (source, kind), n in list(seen.items()):
        seen[ALL_SOURCES, kind] += n
        ends[ALL_SOURCES, kind] += ends[source, kind]
    stream = stream or Stream(texts)
    for w, n in zip(stream.names, np.bincount(stream.numbers, minlength=len(stream.names)).tolist()):
        words[w] += n
    words = Counter({w: n for w, n in words.items() if n and (w[0].isalpha() or w[0] == "@")})  # no others are looked up
    begins: Counter = Counter()
    for w, n in words.items():
        for i in range(1, len(w)):
            begins[w[:i]] += n
    rows = [(key("b", *x), ends[x], n, 1) for x, n in seen.items()]
    rows += [(key("w", w), n, n, int(w in last)) for w, n in words.items()]
    rows += [(key("p", b), n, n, int(b in last)) for b, n in begins.items()]
    rows += [(key("w", w), 0, 0, 1) for w in last.keys() - words.keys()] + [(key("p", w), 0, 0, 1) for w in last.keys() - begins.keys()]
    rows += [(key("f", w), n, n, 1) for w, n in last.items()]
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"k": table[:, 0], "e": table[:, 1], "a": table[:, 2], "asked": table[:, 3]}


def evidence(texts: list[str], stream: Stream | None = None, filter_: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """k, e, a: key, ends and all occurrences of contexts and first words, with a
    filter only of those it holds.  They are hashed for all positions at once."""
    stream = stream or Stream(texts)
    parts: list[np.ndarray] = [np.empty((0, 3), np.int64)]

    def add(total: np.ndarray, is_end: np.ndarray) -> None:
        keys = (total >> np.uint64(1)).astype(np.int64)
        if filter_ is not None:
            hit = np.flatnonzero(filter_[(keys >> 6) & (SLOTS - 1)] >> (keys & 63) & 1)
            keys, is_end = keys[hit], is_end[hit]
        keys, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        parts.append(np.stack([keys, np.bincount(where, is_end, len(keys)).astype(np.int64), count], 1))

    sizes = stream.sizes
    if len(sizes):
        h = np.array(list(map(token_hash, stream.names)), np.uint64)[stream.numbers]
        begin = np.cumsum(sizes + 1) - sizes - 1
        depth = np.arange(len(h)) - np.repeat(begin, sizes + 1)
        is_end = np.zeros(len(h), bool)
        is_end[begin + sizes] = True
        counted = depth > 0
        counted[(begin + sizes)[~stream.whole]] = False  # the text's end, without a stop
        at = np.flatnonzero(counted)
        is_end, depth = is_end[at], depth[at]
        with np.errstate(over="ignore"):
            total = np.zeros(len(at), np.uint64)
            for k in range(max(ORDERS)):
                step = h[np.maximum(at - k, 0)]
                step *= np.uint64(PLACES[k])
                step[depth < k] = 0
                total += step
                if k + 1 in ORDERS:
                    add(total + np.uint64(token_hash(f"order {k + 1}")), is_end)
            for n in STARTS:
                long = np.flatnonzero(sizes >= (1 if n == STARTS[-1] else n))
                size = np.minimum(sizes[long], n)
                base = np.array([token_hash(f"start {i}") for i in range(n + 1)], np.uint64)
                total = base[size]
                for k in range(n):
                    has = size > k
                    total[has] += h[begin[long[has]] + 1 + k] * np.uint64(PLACES[k])
                add(total, stream.stops[long])
    table = np.concatenate(parts)
    return {"k": table[:, 0], "e": table[:, 1], "a": table[:, 2]}


def counts(texts: list[str], sources: list[str | None], fitted: list[bool], filter_: np.ndarray) -> dict[str, np.ndarray]:
    """k, e, a, asked: frequencies of all texts (asked 1) and evidence of the fitted
    ones with the contexts that any of them asks for (asked 2)."""
    stream = Stream(texts)
    known = frequencies(texts, sources, stream)
    if not all(fitted):
        texts_in = [t for t, f in zip(texts, fitted) if f]
        seen = evidence(texts_in, None, filter_)
    else:
        seen = evidence(texts, stream, filter_)
    asked = asked_contexts(texts)["k"]
    none, some = np.zeros(len(asked), np.int64), np.zeros(len(seen["k"]), np.int64)
    return {
        "k": np.concatenate([known["k"], seen["k"], asked]),
        "e": np.concatenate([known["e"], seen["e"], none]),
        "a": np.concatenate([known["a"], seen["a"], none]),
        "asked": np.concatenate([known["asked"], some, none + 2]),
    }


class Model:
    """Looks up (ends, all) by key."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, total: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ends, self.total = keys[order], ends[order], total[order]

    def get(self, *parts: str) -> tuple[int, int]:
        return self.at(key(*parts))

    def at(self, k: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.keys, k))
        return (int(self.ends[i]), int(self.total[i])) if i < len(self.keys) and self.keys[i] == k else (0, 0)

    def start_share(self, t: list[str], least: int = LEAST_SEEN) -> tuple[float, int]:
        """Share of passages with these first words that end with a stop."""
        for n in STARTS:
            e, a = self.at(start_key(t[:n]))
            if a >= least:
                return e / a, a
        return 0.0, 0

    def end_share(self, seq: list[str], orders: tuple[int, ...] = ORDERS[:-1], least: int = LEAST_SEEN) -> tuple[float, int] | None:
        """Share of ends and occurrences of the longest context with enough of them."""
        for n in orders:
            e, a = self.at(context_key(seq, n))
            if a >= least:
                if n >= len(seq) and e:
                    return 1.0, a  # the whole passage is known as a complete one
                return e / a, a
        return None

    def baseline(self, source: str | None, kind: str) -> float | None:
        """Share of the source's units of this kind that end with a terminator."""
        for x in (source or "", ALL_SOURCES):
            e, a = self.get("b", x, kind)
            if a >= LEAST_UNITS:
                return e / a
        return None

    def cut_word(self, word: str) -> bool:
        """A word that is never or hardly met inside texts but begins one that is.
        Words that end more texts than they begin longer words are whole."""
        if not (word[0].isalpha() or word[0] == "@"):
            return False
        longer = self.get("p", word)[1]
        return longer > 0 and longer >= self.get("f", word)[1] and self.get("w", word)[1] <= CUT_RATIO * longer


def by_block(count):
    """A mapInPandas function that counts some texts (the first column) at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = pdf.iloc[:, 0].tolist()
            low = chars = 0
            for high, t in enumerate([*first, None], 1):
                chars += len(t or "")
                if high - low >= BLOCK_TEXTS or chars >= BLOCK_CHARS or high > len(first):
                    some = pdf.iloc[low:high]
                    yield pd.DataFrame(count(*(some[c].tolist() for c in pdf)))
                    low, chars = high, 0

    return filled(run)


def asked_filter(df: DataFrame, text: str) -> np.ndarray:
    """Bits of all contexts and first words that the texts' ends ask for, of fixed size."""
    keys = df.select(F.col(f"`{text}`").alias("t")).mapInPandas(by_block(asked_contexts), "k long")
    slots = (
        keys.groupBy(F.expr(f"shiftright(k, 6) & {SLOTS - 1}L").alias("slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(k & 63 as int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(SLOTS, np.int64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out


def fit(df: DataFrame, text: str, source: str | None = None, fit_rows: int | None = None) -> Model:
    """Model whose contexts, words and sources are counted over all texts.  With
    fit_rows, contexts come from about that many texts only, chosen by a hash.

    A first pass marks the contexts that the texts' ends ask for in a filter of
    fixed size, a second counts what passes it, inside each block and then per
    key; what nothing asks for is dropped, and so are contexts met too rarely to
    tell anything.  What reaches the driver is the filter and the counts of the
    different last words and of the asked contexts met LEAST_SEEN times.
    """
    fitted = F.lit(True)
    if fit_rows is not None and (total := df.count()) > fit_rows:
        fitted = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(1_000_000)) < int(1e6 * fit_rows / total)
    where = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")) if source else F.lit(None)
    bits = df.sparkSession.sparkContext.broadcast(asked_filter(df, text))
    counted = (
        df.select(F.col(f"`{text}`").alias("t"), where.cast("string").alias("s"), fitted.alias("f"))
        .mapInPandas(by_block(lambda t, s, f: counts(t, s, f, bits.value)), "k long, e long, a long, asked long")
        .groupBy("k")
        .agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.max("asked").alias("asked"))
        .where(f"asked = 1 and (a > 1 or e > 0) or asked = 2 and a >= {LEAST_SEEN}")
        .select("k", "e", "a")
        .toArrow()
    )
    return Model(*(counted[c].to_numpy() for c in ("k", "e", "a")))


# Marks that stand for lost text.
CUT_MARK = re.compile(
    r"(?:…|\.\.\.+|�|[\[(（<{]\s*(?:…|\.\.\.+|truncated|cut|cut off|more|continued|cont\.?|snip|gekürzt|mehr|más|cortado|截断|未完|更多)"
    r"\s*[\])）>}])\s*$",
    re.I,
)
BROKEN_TAIL = re.compile(
    r"</?[A-Za-z][^<>]{0,80}$|</?$|<!-?-?[^<>]*$"  # markup
    r"|&(?:#[xX]?[0-9a-fA-F]*|[a-z]{1,8})?$"  # entity
    r"|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$"  # escape
    r"|%[0-9A-F]{2}%[0-9A-F]?$"  # URL escape
    r"|[\ud800-\udfff]$"
    r"|[ÂÃâ][\u0080-\u00bf]?$"  # the first bytes of a character, read one by one
)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*?)?(/?)>")
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "p", "li", "td", "tr", "th"}
PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "”": "“", "»": "«", "》": "《"}

OPENERS = frozenset(PAIRS.values())
CLOSED_BY = {o: c for c, o in PAIRS.items()}
FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
PARAGRAPH = re.compile(r"\n\s*\n|\r\n\s*\r\n")
JSON_START = re.compile(r"\s*(?:\{\s*(?:\"|\}|$)|\[\s*(?:[\[{\"\]\d]|$))")
JSON_TOKEN = re.compile(r'"(?:[^"\\\\]|\\\\.)*"|["{}\[\]]', re.S)
OPENING = re.compile("[" + re.escape("".join(sorted(OPENERS))) + '„"]')


def open_at_end(text: str) -> str | None:
    """Stack automaton: what is still open at the end of the text, if anything.

    Tags, code fences and the braces of a JSON text must close anywhere in it;
    brackets and quotes of prose must close in the paragraph they open in, so
    only those of the last one count."""
    stack: list[str] = []
    for m in TAG.finditer(text):
        name = m[2].lower()
        if m[3] or name in VOID:
            continue
        if not m[1]:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    if stack or len(FENCE.findall(text)) % 2 or text.count("<!--") > text.count("-->"):
        return "markup"
    if JSON_START.match(text):
        return json_open(text)
    last = TAG.sub("", PARAGRAPH.split(text)[-1])
    if not OPENING.search(last):
        return None
    for line in last.splitlines():
        # A list entry "a)" closes nothing.
        body = line.partition(")")[2] if re.match(r"\s*(?:\d+|[A-Za-z])\)", line) else line
        for i, c in enumerate(body):
            if c == "„":
                stack.append("“")
            elif c == '"':
                if stack and stack[-1] == '"':
                    stack.pop()
                elif i + 1 < len(body) and not body[i + 1].isspace() and (not i or not body[i - 1].isalnum()):
                    stack.append('"')  # else an inch sign or a stray mark
            elif stack and stack[-1] == c:
                stack.pop()
            elif c in OPENERS:
                stack.append(CLOSED_BY[c])
    if not stack:
        return None
    return "quote" if stack[-1] in '"“”»」』' else "bracket"


def json_open(text: str) -> str | None:
    """bracket or quote if a JSON text ends inside one."""
    stack: list[str] = []
    for m in JSON_TOKEN.finditer(text):
        c = m[0]
        if c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack and stack[-1] == c:
                stack.pop()
        elif c == '"':
            return "quote"  # a string without end
    return "bracket" if stack else None


def breaks_off(text: str | None, model: Model, source: str | None = None) -> str | None:
    """How a text breaks off, or None if it is complete: mark, escape, markup,
    bracket, quote, row, list and number by structure; terminator by the source's
    baseline; word and sentence by terminal contexts where the baseline is open.

    Null and blank texts are complete.  Ends that the model has never seen count
    as complete unless a word is cut, so rare notes and names are no case.
    """
    if not text:
        return None
    t = visible(text)
    if not t:
        return None
    if CUT_MARK.search(t):
        return "mark"
    tail = t[-100:]
    if BROKEN_TAIL.search(tail):
        return "escape"
    still = open_at_end(t)
    if still:
        return still
    lines = t.splitlines()
    line = lines[-1].strip()
    if line.startswith("|"):
        before = lines[-2].strip() if len(lines) > 1 else ""
        if not line.endswith("|") or (before.startswith("|") and line.count("|") < before.count("|")):
            return "row"
        return None
    body, last = last_part(t)
    if not body or re.fullmatch(r"(?:[>\-*•+]+|\d+\s*[.)\-:]?)", line) and len(lines) > 1:
        return "list"
    bare = last.rstrip(CLOSERS + " ")
    if bare[-1:] in STOPS and bare:
        # A full stop after a number may be a decimal point.
        seq = [BEGIN, *tokens(bare[:-1])]
        if bare[-1] == "." and seq[-1] == "0":
            share = model.end_share(seq)
            if share and share[1] >= 10 and share[0] < 0.02:
                return "number"
        return None
    if last != bare and bare and last.rstrip()[-1:] in CLOSERS and bare[-1:] not in ",;:，；：、":
        return None  # ends in a closing bracket or quote
    seq = [BEGIN, *tokens(last)]
    if len(seq) == 1:
        return None
    usual = model.baseline(source, kind_of(line))
    if usual is not None and usual >= MUST_STOP:
        return "terminator"
    if model.cut_word(seq[-1]):
        return "word"
    if usual is not None and usual <= NEED_NOT_STOP:
        return None
    if seq[-1] in (",", "，", "、", ";", "；", "-") and len(seq) > 2:
        return "sentence"
    begun, times = model.start_share(seq[1:])
    prose = times and begun >= 0.7
    if prose:
        share = model.end_share(seq)
        if share and share[0] < END_SHARE:
            return "sentence"
        if not share and seq[-1][0].isalpha():
            e, a = model.at(context_key(seq, 1))
            if len(seq[-1]) > 1 and a >= 50 and e < 0.005 * a:
                return "sentence"  # a word that never ends a sentence, in a new context
            if model.get("p", seq[-1])[1]:
                return "word"
    else:
        share = model.end_share(seq, (2,), 20)
        one = model.at(context_key(seq, 1))
        if share and share[0] < 0.02 and one[0] < 0.02 * one[1]:
            return "sentence"
    return None
