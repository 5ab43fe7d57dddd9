"""Token counts by a public tokenizer, whose vocabulary stays where it is."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.session import spread

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("HELIODOR_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens, *keep) of rows with a key; a null text has no tokens. The text itself isn't passed on."""
    fields = [f for f in df.schema.fields if f.name in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for b in batches:
            out = {"key": b["key"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]}
            yield pd.DataFrame(out | {name: b[name] for name in keep})

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *keep)
    schema = "key bigint, tokens bigint" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)
    return spread(rows, "key").mapInPandas(count, schema)
