"""Filling fixed-capacity containers with texts (problem 8).

Method: length-histogram planning.  Best fit decreasing runs on the histogram of
lengths, whose size the capacity bounds, not on the texts; texts then take the
planned slots by their rank within their length.
"""

from __future__ import annotations

import base64
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import filled, materialize


def default_vocabulary() -> str:
    """Path of the public multilingual byte-level vocabulary.

    cl100k_base itself is not available offline; pass the path of its ranks file
    where it is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder(ranks: bytes):
    """Encoding of a ranks file's content, kept for the life of the worker."""
    kept = sys.__dict__.setdefault("_procgraph_encoders", {})
    key = hash(ranks)
    if key not in kept:
        import tiktoken

        pattern = (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's own
        )
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return kept[key]


def token_lengths(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; null text has 0 tokens.  Whole texts are
    tokenized, in Arrow batches, by a byte-level tokenizer whose vocabulary file
    travels as a broadcast (under 1 MB, fixed)."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks.value)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": np.array(n, "int64")})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return out.mapInPandas(filled(count), f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over counts.

    Returns segments (length, first_rank, last_rank, first_container,
    per_container) and the number of containers.  Items of a length with ranks
    in a segment fill its containers in turn, per_container to each.  The number
    of segments is bounded by the number of distinct lengths times open groups,
    not by the number of items.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    open_by_free: dict[int, list[tuple[int, int]]] = {}  # free space: runs (first container, count)
    frees: list[int] = []
    made = 0

    def put(free: int, first: int, count: int) -> None:
        if count and free > 0:
            if free not in open_by_free:
                open_by_free[free] = []
                insort(frees, free)
            open_by_free[free].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("an item is longer than the capacity")
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(frees, length)
            if i < len(frees):
                free = frees[i]
                first, count = open_by_free[free].pop()
                if not open_by_free[free]:
                    del open_by_free[free]
                    frees.pop(i)
            else:
                free, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            each = free // length
            full = min(count, left // each)
            if full:
                segments.append((length, rank, rank + full * each - 1, first, each))
                rank, left = rank + full * each, left - full * each
                put(free - each * length, first, full)
            if left and full < count:  # the last items of this length share one container
                segments.append((length, rank, rank + left - 1, first + full, left))
                put(free - left * length, first + full, 1)
                put(free, first + full + 1, count - full - 1)
                left = 0
            else:
                put(free, first + full, count - full)
    return segments, made


def pack(lengths: DataFrame, key: str, capacity: int = 2048) -> DataFrame:
    """Container of every piece of every item of (key, n_tokens).

    Columns: key, piece, n_pieces, token_start, tokens, container.  Only items
    longer than the capacity are split, into full containers and a rest.  Items
    without tokens need no space: they get one row with a null container.  Ties
    are placed in the order of key; repeated keys are items of their own.

    lengths is written once, so that texts are tokenized once though the range
    partitioning reads them twice; the placed pieces are too, since planning and
    placing must agree.
    """
    spark: SparkSession = lengths.sparkSession
    lengths = materialize(lengths)
    n = F.col("n_tokens")
    pieces = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    items = materialize(
        lengths.select(F.col(f"`{key}`").alias("k"), "n_tokens", pieces.alias("n_pieces"))
        .select("k", "n_tokens", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .withColumn("token_start", F.col("piece").cast("long") * capacity)
        .withColumn("tokens", F.least(F.lit(capacity).cast("long"), n - F.col("token_start")))
        .drop("n_tokens")
        # A hot length spreads over many partitions: order by key too.
        .repartitionByRange("tokens", "k", "piece")
        .sortWithinPartitions("tokens", "k", "piece")
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    starts = items.groupBy("tokens", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    # At most capacity + partitions rows: they bound what comes to the driver.
    held = sorted((r.tokens, r.part, r.first, r.size) for r in starts.collect())
    histogram: dict[int, int] = {}
    offsets = []
    for tokens, p, first, size in held:
        offsets.append((tokens, p, first, histogram.get(tokens, 0)))
        histogram[tokens] = histogram.get(tokens, 0) + size
    segments, _ = plan_slots(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, a, b, c, each in segments:
        by_length.setdefault(length, []).append((a, b, c, each))
    plan = spark.createDataFrame(
        list(by_length.items()),
        "tokens long, segments array<struct<a: long, b: long, c: long, each: long>>",
    )
    shift = spark.createDataFrame(offsets, "tokens long, part long, first long, earlier long")
    rank = F.col("at") - F.col("first") + F.col("earlier")
    mine = F.filter("segments", lambda s: (s["a"] <= F.col("r")) & (F.col("r") <= s["b"]))[0]
    return (
        items.withColumn("part", part)
        .join(F.broadcast(shift), ["tokens", "part"])
        .join(F.broadcast(plan), "tokens", "left")
        .withColumn("r", rank)
        .withColumn("s", mine)
        .select(
            F.col("k").alias(key),
            "piece",
            "n_pieces",
            "token_start",
            "tokens",
            (F.col("s.c") + F.floor((F.col("r") - F.col("s.a")) / F.col("s.each"))).alias("container"),
        )
    )
