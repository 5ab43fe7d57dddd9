"""Vectors of texts. The model is pluggable; the built-in one hashes words, so that tests need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.operators.search import tokenize

DIMENSION, MOST_CHARS = 384, 2_000
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Unit vectors from signed hashes of the words of each text's first characters; an empty text gives zeros."""
    out = np.zeros((len(texts), DIMENSION), np.float32)
    for row, text in zip(out, texts):
        for word in tokenize((text or "")[:MOST_CHARS]):
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            row[int.from_bytes(h[:4], "little") % DIMENSION] += 1 if h[4] & 1 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def pending(content: DataFrame, mapping: DataFrame) -> DataFrame:
    """Content rows without a vector."""
    return content.join(mapping.select("content_rowid"), "content_rowid", "left_anti")


def embed(content: DataFrame, mapping: DataFrame, embedder: Embedder = hashing_embedder, batch: int = 32, carry: tuple[str, ...] = ()) -> DataFrame:
    """(content_rowid, embedding, *carry) of the pending rows: title, blank line, body; `carry` names columns of `content`."""

    @F.pandas_udf("array<float>")
    def vectors(text: pd.Series) -> pd.Series:
        parts = [embedder(text.iloc[i : i + batch].tolist()) for i in range(0, len(text), batch)]
        return pd.Series([v for p in parts for v in p], dtype=object)

    text = F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return pending(content, mapping).select("content_rowid", vectors(text).alias("embedding"), *carry)


def orphans(content: DataFrame, mapping: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors that no content row needs."""
    alive = mapping.join(content.select("content_rowid"), "content_rowid", "left_semi").select("vec_rowid")
    return vectors.join(alive, "vec_rowid", "left_anti").select("vec_rowid")
