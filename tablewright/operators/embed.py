"""Pluggable model steps: texts to vectors, raw SQL to simpler SQL."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import is_blank, strip_code_fence

Embedder = Callable[[list[str]], Sequence[Sequence[float]] | np.ndarray]
Rewriter = Callable[[str, str], str]

# --- Fixed values -------------------------------------------------------------------
ATTEMPTS = 3
WAIT_SECONDS = (1.0, 10.0)
# ------------------------------------------------------------------------------------
BATCH_TEXTS = 256
# Texts that fail in a row before the rest of their batch is not tried.
GIVE_UP = 20


class HashedTokens:
    """An offline embedder: token counts in hashed buckets, at unit length."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([self._one(text) for text in texts]).reshape(len(texts), self.dimensions)

    def _one(self, text: str) -> np.ndarray:
        buckets = [zlib.crc32(t.encode()) % self.dimensions for t in re.findall(r"\w+", text.lower())]
        counts = np.bincount(np.array(buckets, dtype=int), minlength=self.dimensions).astype(float)
        size = np.linalg.norm(counts)
        return counts / size if size else counts


def _attempt(embedder: Embedder, texts: list[str], wait: tuple[float, float], attempts: int) -> list[np.ndarray]:
    for attempt in range(1, attempts + 1):
        try:
            vectors = embedder(texts)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(min(wait[1], wait[0] * 2 ** (attempt - 1)))
            continue
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
        return [np.asarray(v, np.float64) for v in vectors]
    return []


class _Batches:
    """Texts to vectors or errors; a batch that fails is halved until the texts that fail stand alone.

    ``k`` bad texts among ``n`` cost about ``2 k log n`` calls. The whole batch and a single text are
    tried ``ATTEMPTS`` times, what lies between once. After ``GIVE_UP`` texts have failed one after
    the other, as when a model is down, the rest of the batch is not tried.
    """

    def __init__(self, embedder: Embedder, wait: tuple[float, float]) -> None:
        self.embedder, self.wait, self.failed = embedder, wait, 0

    def run(self, texts: list[str]) -> tuple[list[np.ndarray | None], list[str | None]]:
        self.failed = 0
        return self._part(texts, ATTEMPTS)

    def _part(self, texts: list[str], attempts: int) -> tuple[list[np.ndarray | None], list[str | None]]:
        if self.failed >= GIVE_UP:
            return [None] * len(texts), [f"not tried after {GIVE_UP} failures"] * len(texts)
        try:
            found = _attempt(self.embedder, texts, self.wait, attempts)
            self.failed = 0
            return list(found), [None] * len(texts)
        except Exception as error:  # noqa: BLE001 - reported in the row
            if len(texts) == 1:
                self.failed += 1
                return [None], [f"{type(error).__name__}: {error}"]
        half = len(texts) // 2
        vectors, errors = [], []
        for part in (texts[:half], texts[half:]):
            found, reasons = self._part(part, ATTEMPTS if len(part) == 1 else 1)
            vectors += found
            errors += reasons
        return vectors, errors


def _vector_array(vectors: list[np.ndarray | None]) -> pa.Array:
    """Vectors as an Arrow array over one block of numbers."""
    sizes = np.array([0 if v is None else len(v) for v in vectors], np.int64)
    flat = np.concatenate([v for v in vectors if v is not None] or [np.zeros(0)])
    missing = pa.array([v is None for v in vectors], pa.bool_())
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array(flat, pa.float64()), mask=missing)


def embed(
    df: DataFrame,
    text_col: str,
    embedder: Embedder,
    batch: int = BATCH_TEXTS,
    wait: tuple[float, float] = WAIT_SECONDS,
) -> DataFrame:
    """Adds ``embedding`` and ``error``; a row whose text cannot be embedded keeps a null vector.

    A null text is embedded as an empty one. The embedder may return lists or a numpy matrix.
    """

    @F.arrow_udf("embedding array<double>, error string")
    def vectors(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tries = _Batches(embedder, wait)
        for texts in arrays:
            parts = []
            for start in range(0, max(len(texts), 1), batch):
                few = [t or "" for t in texts.slice(start, batch).to_pylist()]
                found, errors = tries.run(few) if few else ([], [])
                parts.append(pa.StructArray.from_arrays([_vector_array(found), pa.array(errors, pa.string())], ["embedding", "error"]))
            yield pa.concat_arrays(parts)

    return (
        df.withColumn("_embedded", vectors(F.col(text_col)))
        .withColumns({"embedding": F.col("_embedded.embedding"), "error": F.col("_embedded.error")})
        .drop("_embedded")
    )


def simplify_sql(
    df: DataFrame,
    rewrite: Rewriter | None,
    sql_col: str = "sql",
    title_col: str = "element_title",
    sql_chars: int | None = None,
) -> DataFrame:
    """Replaces SQL by ``rewrite(sql, title)``; no rewriter, a failure or an empty answer keeps it.

    The rewriter is shown whole texts. With ``sql_chars`` a longer SQL is not rewritten, as the
    answer to a part of it would lose the rest.
    """
    if rewrite is None:
        return df

    @F.pandas_udf("string")
    def rewritten(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(sql: str | None, title: str | None) -> str | None:
            if not sql or not sql.strip():
                return None
            try:
                return rewrite(sql, title or "")
            except Exception:  # noqa: BLE001 - the input stands in for a failed answer
                return None

        for sqls, titles in series:
            yield pd.Series([one(s, t) for s, t in zip(sqls, titles)], dtype=object)

    raw = F.col(sql_col)
    shown = raw if sql_chars is None else F.when(F.char_length(raw) <= sql_chars, raw)
    answer = strip_code_fence(rewritten(shown, F.col(title_col)))
    return df.withColumn(
        sql_col, F.when(is_blank(raw), raw).otherwise(F.coalesce(F.nullif(answer, F.lit("")), raw))
    )
