"""Source archives: zip bytes into files, and their summary."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.functions.text import is_source_file, language_of, truncate_source, url_id


#: What a damaged, encrypted or unsupported archive or entry raises.
BROKEN = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError)


def entries(df: DataFrame, key: str, payload: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """(key, path, content, error): the files of each archive, folders left out, with `endings` (lower case) only.

    A broken archive gives one row with an error and no path, a file that can't be read one with an error and no content.
    Of files with the same path the last counts.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(*values) -> pd.DataFrame:
            return pd.DataFrame([values], columns=["key", "path", "content", "error"])

        for b in batches:
            for k, data in zip(b["key"], b["payload"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        for info in {i.filename: i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(endings)}.values():
                            try:
                                yield row(k, info.filename, z.read(info).decode("utf-8", "replace"), None)
                            except BROKEN as e:
                                yield row(k, info.filename, None, str(e))
                except BROKEN as e:
                    yield row(k, None, None, str(e))

    return df.select(F.col(key).cast("string").alias("key"), F.col(payload).alias("payload")).mapInPandas(unpack, "key string, path string, content string, error string")


def source_files(files: DataFrame, url: str) -> DataFrame:
    """Rows of code files: only sources that could be read, with the id and address of `url`#path."""
    at = F.concat(F.col(url), F.lit("#"), F.col("path"))
    return files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & is_source_file(F.col("path"))).withColumn("code_url", at).withColumn("id", url_id(at))


def summary(files: DataFrame, by: list[str], title: str, url: str) -> DataFrame:
    """Markdown of each sample: its files in order, long ones cut. One archive's files are one group."""
    part = F.concat(F.lit("### "), "path", F.lit("\n\n```"), language_of(F.col("path")), F.lit("\n"), truncate_source(F.col("content")), F.lit("\n```\n\n"))
    parts = files.groupBy(*by, title, url).agg(F.array_sort(F.collect_list(F.struct("path", part.alias("text")))).alias("parts"))
    head = F.concat(F.lit("# "), F.col(title), F.lit("\n\nURL: "), F.col(url), F.lit("\n\n## Source Files ("), F.size("parts").cast("string"), F.lit(")\n\n"))
    return parts.select(*by, F.concat(head, F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("markdown"))
