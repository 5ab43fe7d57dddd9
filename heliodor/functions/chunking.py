"""Chunks of at most 10,000 characters, as the index stores them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 10_000
#: Fixed value: the white space cut off a chunk's ends.
SPACE = " \t\n\x0b\f\r\xa0                　﻿"
#: Where a chunk may end, from the best place to the last resort; sentence ends count as one kind.
BREAKS = (("\n\n",), ("\n",), (". ", "! ", "? "), (" ",))


def break_point(text: str, most: int) -> int:
    """Where to cut: after the last break of the best kind that begins behind the middle, at `most` at the latest."""
    for kind in BREAKS:
        begins = max(text.rfind(b, 0, most + len(b)) for b in kind)
        if begins > most * 0.5:
            return begins + len(kind[0])
    return most


def chunks(text: str, most: int = MOST) -> list[str]:
    """A text within the limit is one chunk as it is; a longer one is cut and its chunks are trimmed."""
    out = []
    while len(text) > most:
        cut = break_point(text, most)
        out.append(text[:cut].strip(SPACE))
        text = text[cut:].strip(SPACE)
    if text or not out:
        out.append(text)
    return out


def chunk_table(df: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """(key, chunk_index, chunk). Texts within the limit, nearly all, never leave the JVM; null texts give no row."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, i, c) for k, t in zip(b["key"], b["text"]) for i, c in enumerate(chunks(t, most))]
            yield pd.DataFrame(found, columns=["key", "chunk_index", "chunk"])

    short = rows.where(F.char_length("text") <= most).select("key", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    return short.unionAll(rows.where(F.char_length("text") > most).mapInPandas(cut, f"key {kind}, chunk_index int, chunk string"))
