"""The manifest of resources: inserts, upserts and state changes as plans over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
TYPES = ("doc", "talk", "sample", "code_file")
STATUSES = ("discovered", "fetched", "normalized", "indexed", "failed")
FETCHABLE = ("discovered", "failed")
PRIORITY = {"wwdc": 1, "whats-new": 2, "doc-graph": 3, "sample-library": 4}
DISCOVERY_ORDER = ("wwdc", "whats-new", "technologies", "doc-graph", "sample-library")
YEAR_MS = 365 * 24 * 3600 * 1000


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order`. Null keys form one group, as in GROUP BY."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))  # combined before the shuffle
    return picked.select("row.*")


def insert_ignore(existing: DataFrame, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """`existing` and the rows of `new` whose id and url are both new; among equal ones in `new` the first in `order` wins."""
    rank = order or [F.col("url"), F.col("id")]
    fresh = new.where("id IS NOT NULL AND url IS NOT NULL").join(existing.select("id"), "id", "left_anti").join(existing.select("url"), "url", "left_anti")
    fresh = first_of_each(first_of_each(fresh.select(*new.columns), ["url"], rank), ["id"], rank)
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`existing` with the rows of `new` put in the place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new, allowMissingColumns=True)


def patch(existing: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`existing` with `columns` overwritten where `new` has a value for the key."""
    renamed = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = existing.join(renamed, existing[key] == F.col("__key"), "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), existing[c]).alias(c) if c in columns else existing[c] for c in existing.columns))


def delete_keys(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti").select(*existing.columns)


def delete_with_vectors(ids: DataFrame, content: DataFrame, mapping: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Content, map and vectors without the content rows of `ids` and what hangs on them."""
    gone = content.join(ids.select("id"), "id", "left_semi").select("content_rowid")
    gone_vectors = mapping.join(gone, "content_rowid", "left_semi").select("vec_rowid")
    return delete_keys(content, ids, "id"), delete_keys(mapping, gone, "content_rowid"), delete_keys(vectors, gone_vectors, "vec_rowid")


def refresh(manifest: DataFrame, now_ms: int, age_ms: int | None = YEAR_MS) -> DataFrame:
    """Back to 'discovered': all fetched rows (age None), or those fetched strictly before now - age. Null times stay."""
    stale = F.col("fetched_at").isNotNull() & ((F.col("fetched_at") < now_ms - age_ms) if age_ms is not None else F.lit(True))
    return manifest.withColumn("status", F.when(stale, "discovered").otherwise(F.col("status")))


def reset_all(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("status", F.lit("discovered"))


def source_priority(source: Column) -> Column:
    out = F.lit(5)
    for name, rank in PRIORITY.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def fetchable(manifest: DataFrame) -> DataFrame:
    """Rows to fetch; failed ones without validators, so that a stale 304 can't hide them."""
    failed = F.col("status") == "failed"
    rows = manifest.where(F.col("status").isin(*FETCHABLE))
    return rows.withColumn("etag", F.when(~failed, F.col("etag"))).withColumn("last_modified", F.when(~failed, F.col("last_modified"))).withColumn("priority", source_priority(F.col("source")))


def merge_discoveries(found: DataFrame) -> DataFrame:
    """One row for each url over all discovery sources; the source that is asked first wins."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, DISCOVERY_ORDER)), F.col("source")).cast("int"), F.lit(0))
    order = F.when(order == 0, 99).otherwise(order)
    return first_of_each(found.where("url IS NOT NULL"), ["url"], [order, F.col("id")])


def after_fetch(status: Column, http_ok: Column, not_modified: Column, previous: Column) -> Column:
    """The status after a fetch: an unchanged record gets its former status back."""
    return F.when(not_modified, previous).when(http_ok, "fetched").otherwise("failed")


def violations(manifest: DataFrame) -> DataFrame:
    """Rows that break a constraint, with its name: keys, required fields and fixed values."""
    def dup(c: str) -> DataFrame:
        return manifest.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate {c}").alias("rule"), F.col(c).alias("value"))

    bad = [dup("id"), dup("url")]
    for c, allowed in (("type", TYPES), ("status", STATUSES)):
        bad.append(manifest.where(F.col(c).isNull() | ~F.col(c).isin(*allowed)).select(F.lit(f"bad {c}").alias("rule"), F.col("id").alias("value")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionAll(b)
    return out


def ordinal(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
