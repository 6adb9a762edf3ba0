"""Text cut off by field limits (problem 10).

Method: a structural completeness check with a stack automaton (open markup,
brackets and quotes, broken escapes and characters, cut table rows and list
entries), and the missing terminator judged by the terminal contexts and the
source's baseline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terminal import breaks_off, fit
from ..session import filled


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, reason) of every row; reason is null where the text is
    complete.  Whole texts are read, and the model is counted over all of them;
    nothing is shuffled but its counts.  Null and blank texts are complete."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, text, source))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            reasons = [breaks_off(t, m, s) for t, s in zip(pdf["t"], pdf["s"])]
            yield pd.DataFrame({"k": pdf["k"], "s": pdf["s"], "reason": pd.Series(reasons, dtype=object, index=pdf.index)})

    kind = df.schema[key].dataType.simpleString()
    cols = [F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{text}`").alias("t")]
    out = df.select(*cols).mapInPandas(filled(judge), f"k {kind}, s string, reason string")
    return out.withColumnsRenamed({"k": key, "s": source})


def share_by_source(judged: DataFrame, source: str) -> DataFrame:
    """(source, n_documents, n_truncated, share); a missing source is a group of its own."""
    return judged.groupBy(source).agg(
        F.count("*").alias("n_documents"),
        F.count("reason").alias("n_truncated"),
        F.round(F.count("reason") / F.count("*"), 6).alias("share"),
    )
