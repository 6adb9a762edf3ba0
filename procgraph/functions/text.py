"""Scalar text functions as column expressions (ids: SURVEY section 2.11, 2.2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens counted by the public encoding, times the safety factor.
TOKEN_FACTOR = 1.15


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (Spark's trim knows only the blank)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_chinese(c: Column) -> Column:
    """Any ideograph of the basic block."""
    return F.coalesce(c.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def chunk_id(source: Column, index: Column) -> Column:
    """file name with dots as underscores, index, 8 hex digits of an md5."""
    number = index.cast("string")
    digest = F.substring(F.md5(F.concat(source, F.lit("_"), number)), 1, 8)
    return F.concat(F.replace(source, F.lit("."), F.lit("_")), F.lit("_"), number, F.lit("_"), digest)


def overlap_text(c: Column, size: int) -> Column:
    """the last size characters."""
    return F.right(c, F.lit(size))


def collapse_blanks(c: Column) -> Column:
    """runs of blanks become one."""
    return F.regexp_replace(c, " {2,}", " ")


def question_hash(c: Column) -> Column:
    """md5 of the question without outer white space, with Unix line ends."""
    return F.md5(F.replace(strip(c), F.lit("\r\n"), F.lit("\n")))


def cut(c: Column, size: int = 300) -> Column:
    """at most size characters, with an ellipsis where something was cut."""
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def scaled_tokens(raw: Column) -> Column:
    """F8: raw count times 1.15, truncated; in double precision, as the decimal
    product differs for some counts."""
    return F.floor(raw * F.lit(TOKEN_FACTOR)).cast("long")


def blank_tokens(c: Column) -> Column:
    """Number of pieces between white space: the offline proxy of a tokenizer."""
    return F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(strip(c), r"(?U)\s+"))).cast("long")


def proxy_tokens(c: Column) -> Column:
    """F8 with the offline proxy; null counts as empty."""
    return scaled_tokens(F.coalesce(blank_tokens(c), F.lit(0)))


def truncate_to_tokens(c: Column, n: Column) -> Column:
    """F9 with the offline proxy: the first n pieces and an ellipsis; texts that
    fit stay as they are."""
    parts = F.split(strip(c), r"(?U)\s+")
    short = F.concat(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1)).cast("int")), " "), F.lit("..."))
    return F.when(blank_tokens(c) <= n, c).when(n <= 0, F.lit("")).otherwise(short)


def token_counter(path: str, factor: float = TOKEN_FACTOR):
    """F8 with a byte-level ranks file: an Arrow UDF string -> long."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for t in texts:
            yield t.map(lambda x: int(len(enc.encode_ordinary(x)) * factor) if x else 0)

    return count


def format_token_count(n: Column) -> Column:
    """999, 1.50K, 2.00M."""
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1_000_000, F.format_string("%.2fK", n / 1000))
        .otherwise(F.format_string("%.2fM", n / 1_000_000))
    )


# Words that tell the type of a question, in order of precedence.
QUESTION_WORDS = {
    "procedural": (
        "步骤", "流程", "怎么做", "如何操作", "操作方法", "怎样进行", "怎么进行", "执行顺序", "操作顺序", "程序", "需要经过",
        "需要哪些步骤", "如何执行", "怎么执行",
    ),
    "conditional": ("如果", "若", "什么情况下", "什么条件", "不满足", "异常时", "故障时", "区别", "不同"),
    "causal": ("为什么", "原因", "导致", "造成", "引起", "后果", "为何", "怎么会"),
}


def question_type(c: Column) -> Column:
    """Procedural before conditional before causal, else factual."""
    out = None
    for kind, words in QUESTION_WORDS.items():
        test = c.rlike("|".join(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("factual")


# Our own wording of the instructions that go with a question type.
FIRST_RULE = {
    "procedural": "open with the question's key terms and what the operation achieves",
    "conditional": "open with the question's key terms and a summary of the cases",
    "causal": "open with the question's key terms and the main cause or effect",
    "factual": "open with the question's key terms and the value itself",
}
COMMON_RULES = (
    "be brief; list the steps of a procedure in order; state conditions as when ..., then ...; give values with "
    "units; use only the reference material; say that it cannot be answered only if nothing there bears on it"
)


def answer_instructions(kind: Column) -> Column:
    """instructions by question type."""
    rules = F.create_map(*[F.lit(x) for kv in FIRST_RULE.items() for x in kv])
    return F.concat(F.lit("1. "), F.coalesce(rules[kind], F.lit(FIRST_RULE["factual"])), F.lit("\n2. " + COMMON_RULES))


# Headers that a diagram may have, parts of which it must hold one, and placeholders.
DIAGRAM_HEADERS = (
    "flowchart", "graph", "sequencediagram", "classdiagram", "statediagram", "erdiagram", "journey", "gantt", "pie", "mindmap",
)
DIAGRAM_PARTS = ("-->", "-.>", "==>", "->>", "-->>>", "[", "{")
DIAGRAM_PLACEHOLDERS = ("...", "…", "......", "[待补充]", "[placeholder]", "todo", "tbd")


def valid_mermaid(c: Column) -> Column:
    """No placeholder, at least 20 characters, a known header, and an arrow or bracket."""
    low = F.lower(strip(c))
    header = reduce(lambda a, b: a | b, [low.startswith(h) for h in DIAGRAM_HEADERS])
    linked = reduce(lambda a, b: a | b, [c.contains(x) for x in DIAGRAM_PARTS])
    real = ~low.isin(*DIAGRAM_PLACEHOLDERS) & (F.length(low) >= 20)
    return F.coalesce(real & header & linked, F.lit(False))


# Answers that only look like success.
FAKE_EXACT = ("无法回答", "无法生成答案", "", "根据当前可用数据，无法找到与该问题直接相关的信息。")
FAKE_STARTS = ("生成答案时出错:", "无法生成答案：", "假成功-", "无法回答：")
FAKE_PART = "I am sorry but I am unable to answer"


def fake_success(status: Column, answer: Column) -> Column:
    """P10: a success without a real answer."""
    a = strip(F.coalesce(answer, F.lit("")))
    test = a.isin(*FAKE_EXACT) | a.contains(FAKE_PART)
    for s in FAKE_STARTS:
        test = test | a.startswith(s)
    return F.coalesce(status == "success", F.lit(False)) & test


def needs_retry(status: Column, answer: Column) -> Column:
    """P10: failed, or successful in name only."""
    return F.coalesce(status == "error", F.lit(False)) | fake_success(status, answer)


def error_class(status: Column, answer: Column, error: Column) -> Column:
    """A5: class of a failed row: 429, timeout, fake_success or other; null for good rows."""
    e = F.lower(F.coalesce(error, F.lit("")))
    failed = F.coalesce(status, F.lit("")) != "success"
    return (
        F.when(failed & (e.contains("429") | e.contains("rate_limit") | e.contains("rate limit")), "429")
        .when(failed & e.contains("timeout"), "timeout")
        .when(fake_success(status, answer), "fake_success")
        .when(failed, "other")
    )


# Names of node types in both languages.
NODE_TYPES = {
    "event": "event", "condition": "condition", "constraint": "constraint", "equipment": "equipment",
    "parameter": "parameter", "设备": "equipment", "人员": "event", "物质": "event", "事件": "event",
    "条件": "condition", "判断": "condition", "参数": "parameter", "约束": "constraint",
}
# Words of a relation that make an edge causal or a trigger.
CAUSAL_WORDS = ("导致", "引发", "造成", "引起", "产生", "影响")
TRIGGER_WORDS = ("触发", "启动", "激活", "开始")


def node_type(c: Column) -> Column:
    """F16: known names, else event."""
    names = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(strip(c))), F.lit("event"))


def edge_type(kind: Column, relation: Column) -> Column:
    """the relation's words decide, then the type, else causal."""
    r, k = F.lower(F.coalesce(relation, F.lit(""))), F.lower(strip(F.coalesce(kind, F.lit(""))))
    return (
        F.when(r.rlike("|".join(CAUSAL_WORDS)), "causal")
        .when(r.rlike("|".join(TRIGGER_WORDS)), "triggers")
        .when(k.isin("causal", "triggers", "has_condition", "related"), k)
        .otherwise("causal")
    )


def product_and_procedure(text: Column) -> tuple[Column, Column]:
    """first line without heading marks, split at the first " - "; a title
    without it is a product without procedure."""
    title = strip(F.regexp_replace(F.substring_index(text, "\n", 1), r"^#+\s*", ""))
    at = F.instr(title, " - ")
    product = F.when(at > 0, strip(F.left(title, at - 1))).otherwise(title)
    procedure = F.when(at > 0, strip(F.substring(title, at + 3, F.length(title)))).otherwise("")
    return product, procedure
