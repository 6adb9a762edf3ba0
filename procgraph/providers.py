"""Pluggable models.  The defaults are deterministic and offline.

A provider is a small picklable object; `embed_column` and `map_column` run it in
Arrow batches, one call per batch of texts.
"""

from __future__ import annotations

import hashlib
import random
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .session import filled


class EmbeddingProvider(ABC):
    """Texts to vectors.  Queries may be embedded differently from documents."""

    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed([text])[0]


class HashEmbedding(EmbeddingProvider):
    """Signed hashing of character 3-grams, normalised; no model, no network."""

    def __init__(self, dimension: int = 64, gram: int = 3):
        self.dimension, self.gram = dimension, gram

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            t = f" {(t or '').lower()} "
            for j in range(max(1, len(t) - self.gram + 1)):
                h = int.from_bytes(hashlib.blake2b(t[j : j + self.gram].encode("utf-8", "replace"), digest_size=8).digest(), "big")
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


class CallableEmbedding(EmbeddingProvider):
    """Any function from texts to vectors, in batches with pauses, retries and a
    prefix for queries (HTTP services and local models)."""

    def __init__(self, call: Callable[[list[str]], list], dimension: int, batch: int = 10, pause_s: float = 0.0, query_prefix: str = ""):
        self.call, self.dimension, self.batch, self.pause_s, self.query_prefix = call, dimension, batch, pause_s, query_prefix

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = []
        for i in range(0, len(texts), self.batch):
            if i and self.pause_s:
                time.sleep(self.pause_s)
            parts.append(np.asarray(call_with_retry(lambda i=i: self.call(texts[i : i + self.batch])), np.float32))
        return np.concatenate(parts) if parts else np.zeros((0, self.dimension), np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed([self.query_prefix + text])[0]


class LanguageModel(ABC):
    @abstractmethod
    def complete(self, prompt: str) -> str: ...


class EchoModel(LanguageModel):
    """Deterministic stand-in: the first line of the reference material."""

    def complete(self, prompt: str) -> str:
        _, _, rest = prompt.partition("<reference>")
        return rest.partition("</reference>")[0].strip().split("\n")[0]


class EmptyResponse(RuntimeError):
    """A model answered with nothing."""


def is_rate_limit(error: BaseException | None) -> bool:
    """An error that asks to slow down."""
    text = str(error).lower()
    return error is not None and (
        "429" in text or "rate_limit" in text or "insufficient_quota" in text or "RateLimitError" in type(error).__name__
    )


def finished(reason: str | None) -> bool:
    """false where the model's output was cut at its length limit."""
    return reason not in ("length", "max_tokens")


def safe_content(response, *path, default: str = "") -> str:
    """nested access that survives missing parts."""
    for p in path:
        try:
            response = response[p] if isinstance(p, int) or isinstance(response, dict) else getattr(response, p)
        except (KeyError, IndexError, TypeError, AttributeError):
            return default
    return response if isinstance(response, str) else default


def call_with_retry(call: Callable, attempts: int = 10, wait_s: float = 10.0, limiter: "RateLimiter | None" = None, sleep=time.sleep):
    """Retry on an error or an empty answer, after a fixed wait."""
    for n in range(attempts):
        try:
            if limiter:
                with limiter:
                    out = call()
                limiter.succeeded()
            else:
                out = call()
            if out is None or (isinstance(out, str) and not out.strip()):
                raise EmptyResponse("empty response")
            return out
        except Exception as e:  # noqa: BLE001 - any provider error is retried
            if limiter and is_rate_limit(e):
                limiter.limited()
            if n == attempts - 1:
                raise
            sleep(wait_s)
    raise ValueError("attempts must be at least 1")


class RateLimiter:
    """Limits concurrency within a worker; after a rate-limit error everyone waits
    base * min(errors in a row, 6) seconds, give or take 30 percent."""

    def __init__(self, concurrent: int = 16, base_s: float = 60.0, clock=time.time, sleep=time.sleep):
        self._slots = threading.Semaphore(concurrent)
        self._lock = threading.Lock()
        self._base, self._clock, self._sleep = base_s, clock, sleep
        self._row, self.until = 0, 0.0

    def __enter__(self):
        while (left := self.until - self._clock()) > 0:
            self._sleep(left)
        self._slots.acquire()
        return self

    def __exit__(self, *_):
        self._slots.release()

    def limited(self) -> None:
        with self._lock:
            self._row += 1
            wait = self._base * min(self._row, 6) * random.uniform(0.7, 1.3)
            self.until = max(self.until, self._clock() + wait)

    def succeeded(self) -> None:
        with self._lock:
            self._row = 0


def embed_column(df: DataFrame, key: str, text: str, provider: EmbeddingProvider, as_query: bool = False) -> DataFrame:
    """(key, v) of every distinct row's text; each distinct text is embedded once
    per batch (L10)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["t"]]
            once = list(dict.fromkeys(texts))
            vectors = np.stack([provider.embed_query(t) for t in once]) if as_query and once else provider.embed(once)
            at = {t: v for t, v in zip(once, vectors)}
            yield pd.DataFrame({"k": pdf["k"], "v": [at[t] for t in texts]})

    kind = df.schema[key].dataType.simpleString()
    cols = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return cols.mapInPandas(filled(run), f"k {kind}, v array<float>").withColumnRenamed("k", key)


def map_column(df: DataFrame, key: str, text: str, call: Callable[[str], str]) -> DataFrame:
    """(key, output, success, error_message): call on every text; errors are data
    (D20)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                try:
                    out.append((k, call(t or ""), True, None))
                except Exception as e:  # noqa: BLE001 - reported with the row
                    out.append((k, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["k", "output", "success", "error_message"])

    kind = df.schema[key].dataType.simpleString()
    cols = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return cols.mapInPandas(filled(run), f"k {kind}, output string, success boolean, error_message string").withColumnRenamed("k", key)
