"""Problem 5: cut oversized texts at natural boundaries, with an exact overlap between consecutive pieces.

A text is split by a hierarchy of separators: sections, paragraphs, sentences, words, characters. A unit that doesn't fit is
split by the next level, one that fits stays whole; the units are packed greedily up to the limit, and each piece begins
with the last `overlap` characters of the one before. Lengths are Unicode code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.sources.tables import read

#: The project's chunk limit.
LIMIT = 10_000
OVERLAP = 200

#: Where a unit of each level may begin: the end of the match. In order from coarse to fine.
_LEVELS = (
    re.compile(r"\n+(?=#{1,6}[ \t]|(?:=|-|\*){3,}[ \t]*(?:\n|$))"),
    re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"\n+|[.!?][\"'”’)\]]*\s+|[。！？](?:[」』”’）])*\s*"),
    re.compile(r"\s+"),
)


def _by_character(text: str, start: int, end: int, most: int) -> Iterator[int]:
    """Ends of runs of at most `most` characters, a part of the limit so that they pack well; no run starts with a combining mark, if one of the last 32 places allows that."""
    while end - start > most:
        at = start + most
        for back in range(min(32, most - 1)):
            if not unicodedata.combining(text[at - back]) and not (text[at - back] == "\n" and text[at - back - 1] == "\r"):
                at -= back
                break
        yield at
        start = at
    yield end


def _unit_ends(text: str, start: int, end: int, most: int, level: int) -> Iterator[int]:
    """Ends of consecutive units that cover text[start:end], each at most `most` long and as coarse as possible."""
    if end - start <= most:
        yield end
        return
    if level == len(_LEVELS):
        yield from _by_character(text, start, end, max(1, most // 16))
        return
    for match in _LEVELS[level].finditer(text, start, end):
        cut = match.end()
        if start < cut < end:
            yield from _unit_ends(text, start, cut, most, level + 1)
            start = cut
    yield from _unit_ends(text, start, end, most, level + 1)


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `text`. The first starts at 0, each other one `overlap` before the end of the piece
    before it, and the last ends with the text, so the text is the pieces joined without their overlaps."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, len(text))]
    out, start, last = [], 0, 0
    for end in _unit_ends(text, 0, len(text), limit - overlap, 0):
        if end - start > limit:
            out.append((start, last))
            start = max(start, last - overlap)
        last = end
    out.append((start, last))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than `limit`: (key, chunk_index, piece, start, overlap, pieces).

    `chunk_index` counts the pieces of one row from 0. Only rows over the limit, found by Spark, reach Python. Rows with a null
    key or text, and texts within the limit, give no row; a repeated row gives its pieces again; other columns are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                found = spans(t, limit, overlap)
                shared = [0] + [found[i - 1][1] - found[i][0] for i in range(1, len(found))]
                yield pd.DataFrame({"key": [k] * len(found), "chunk_index": range(len(found)), "piece": [t[a:b] for a, b in found], "start": [a for a, _ in found], "overlap": shared, "pieces": len(found)})

    over = df.where(F.col(key).isNotNull() & (F.char_length(F.col(text)) > limit)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return over.mapInPandas(cut, f"key {kind}, chunk_index int, piece string, start int, overlap int, pieces int")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_oversized(read(spark, root, "content").select("content_rowid", "body"), "content_rowid", "body")
    return pieces.where("chunk_index = 1").select(F.col("key").alias("content_rowid")).distinct()


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_oversized(read(spark, root, "content").select("content_rowid", "body"), "content_rowid", "body")
    return pieces.select(F.col("key").alias("content_rowid"), "chunk_index", F.col("piece").alias("body"), "start", "overlap", "pieces")


P5_FOUND_SQL = "SELECT DISTINCT content_rowid FROM content WHERE length(body) > 10000"
