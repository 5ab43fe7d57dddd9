"""Readers for the engine's tables, with their schemas stated instead of inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS = {
    "manifest": "id string, type string, url string, source string, status string, etag string, last_modified string, fetched_at bigint, content_hash string, title string, platforms string",
    "content": "content_rowid bigint, id string, chunk_index int, title string, body string, type string, platforms string, url string, local_path string",
    "content_vec": "vec_rowid bigint, embedding array<float>",
    "content_vec_map": "content_rowid bigint, vec_rowid bigint",
    "doc_graph_progress": "url string, status string, processed_at bigint, refs_found bigint, error string",
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], FIELDS[name])


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """Expose tables as temporary views for plain SQL."""
    for name in names:
        read(spark, root, name).createOrReplaceTempView(name)
