"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def totals(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """One row: resources, content rows, items with content."""
    m = manifest.agg(F.count("*").alias("resources"))
    return content.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("items")).select(m.scalar().alias("resources"), "chunks", "items")


def counts_map(rows: DataFrame, column: str) -> DataFrame:
    """The counts as one JSON object, by name. The groups are the column's few values."""
    held = counts(rows.where(F.col(column).isNotNull()), column)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col("n").alias("v"))))
    return held.agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def recent_failures(progress: DataFrame, limit: int = 10) -> DataFrame:
    """The latest failures, by time and then by url: a report of `limit` rows."""
    return progress.where("status = 'failed'").select("url", "error", "processed_at").distinct().orderBy(F.desc("processed_at"), "url", "error").limit(limit)


def outcomes(log: DataFrame) -> DataFrame:
    """How each run's steps ended."""
    known = F.coalesce("outcome", F.lit("unknown"))
    return log.groupBy("run_id", known.alias("outcome")).agg(F.count_distinct("log_id").alias("n"))
