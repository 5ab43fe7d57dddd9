"""Raw payloads: a store of fetched pages in the place of the network, and the fetch stage over it.

The store is a table (address, payload, etag, last_modified). Anything that fills such a table, a crawler or a stream, is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.functions.text import content_hash, doc_endpoints
from heliodor.operators.incremental import strong_etag


def fetch(todo: DataFrame, store: DataFrame) -> DataFrame:
    """(id, outcome, payload, etag, content_hash, address) for `todo` (id, type, url, etag).

    A doc is looked up at its primary address, then at its fallback, then at its own; others at their own. 'not modified' means
    that the validator still holds, and keeps the payload back; a missing page is 'failed', which is no exception.
    """
    primary, fallback = doc_endpoints(F.col("url"))
    doc = F.col("type") == "doc"
    places = F.when(doc, F.array(primary, fallback, F.col("url"))).otherwise(F.array("url"))
    asked = todo.select("id", F.col("etag").alias("known"), F.posexplode(places).alias("rank", "address"))
    found = asked.join(store.select("address", "payload", "etag"), "address")
    best = found.groupBy("id").agg(F.min_by(F.struct("known", "address", "payload", "etag"), F.struct("rank", "etag")).alias("r"))
    got = todo.select("id").join(best, "id", "left")
    same = F.coalesce(strong_etag(F.col("r.known")) == strong_etag(F.col("r.etag")), F.lit(False))
    outcome = F.when(F.col("r").isNull(), "failed").when(same, "not modified").otherwise("fetched")
    payload = F.when(outcome == "fetched", F.col("r.payload"))
    return got.select("id", outcome.alias("outcome"), payload.alias("payload"), F.col("r.etag").alias("etag"), content_hash(payload).alias("content_hash"), F.col("r.address").alias("address"))


def counters(fetched: DataFrame) -> DataFrame:
    """How many records were fetched, skipped and failed."""
    return fetched.groupBy("outcome").agg(F.count("*").alias("n"))


def archive_files(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(path, payload): the archives of a folder, as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("content").alias("payload"))


def normalized_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text): the files of a folder of normalized texts, whose names are the ids; whole texts."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{md,txt}")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("id"), F.col("value").alias("text"))


def write_by_type(rows: DataFrame, path: str) -> None:
    """Payloads in a folder for each type, so that a stage reads only its own."""
    rows.write.mode("append").partitionBy("type").parquet(path)


def existing(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """(id, payload): what is stored under the current layout, else under the former one."""
    older = legacy.join(current.select("id"), "id", "left_anti")
    return current.select("id", "payload").unionByName(older.select("id", "payload"))
