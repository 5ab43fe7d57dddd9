"""Continuous ingestion: files that arrive in a folder are taken once and published to a versioned target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliodor.operators.incremental import Target, pending


def latest(rows: DataFrame) -> DataFrame:
    """One row for each id: the last by fetched_at, where there is one, then etag and content_hash, nulls first."""
    order = [c for c in ("fetched_at", "etag", "content_hash") if c in rows.columns]
    picked = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))  # combined before the shuffle
    return picked.select("row.*")


def ingest(spark: SparkSession, folder: str, schema: str, target_root: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """A stream over the Parquet files of `folder`, whose rows need id, etag and content_hash.

    Each micro-batch publishes what the target doesn't hold in that version; of several versions of a record in a batch the one
    that `latest` picks, so rows should have fetched_at too: a version older than the target's, which arrives late, is then passed
    over. A batch that is run again after a failure finds its
    rows in the target and publishes nothing, so records are neither skipped nor repeated.
    """
    target = Target(spark, target_root)

    def publish(batch: DataFrame, batch_id: int) -> None:
        held = target.read()
        new = latest(batch)
        if held is not None:
            new = pending(new, held.select("id", "etag", "content_hash"))
            if "fetched_at" in new.columns and "fetched_at" in held.columns:
                newer = held.select(F.col("id").alias("__id"), F.col("fetched_at").alias("__at"))
                new = new.join(newer, (F.col("id") == F.col("__id")) & (F.col("__at") > F.col("fetched_at")), "left_anti")
        target.publish(new)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
