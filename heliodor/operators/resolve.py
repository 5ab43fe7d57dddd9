"""References to resources: ids, doc:// references, paths and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.functions.text import SITE, doc_uri_to_url


def resolve(refs: DataFrame, manifest: DataFrame, site: str = SITE) -> DataFrame:
    """(ref, id, url) of `refs` (ref): exact matches first, then, for addresses, matches whatever the case.

    References that name nothing have a null id; of several matches in another case the smallest url is taken.
    """
    ref = F.col("ref")
    url = F.when(ref.startswith("doc://"), doc_uri_to_url(ref, site)).when(ref.startswith("/documentation/"), F.concat(F.lit(site), ref)).when(ref.startswith(f"{site}/"), ref)
    wanted = refs.select("ref").distinct().withColumn("__url", F.when(~ref.rlike("^[a-f0-9]{16}$"), url)).withColumn("__id", F.when(F.col("__url").isNull(), ref))
    m = manifest.select("id", "url")
    by_id = wanted.join(m, F.col("__id") == m["id"]).select("ref", "id", "url", F.lit(1).alias("rank"))
    exact = wanted.join(m, F.col("__url") == m["url"]).select("ref", "id", "url", F.lit(2).alias("rank"))
    loose = wanted.join(m, F.lower("__url") == F.lower(m["url"])).select("ref", "id", "url", F.lit(3).alias("rank"))
    best = by_id.unionAll(exact).unionAll(loose).groupBy("ref").agg(F.min(F.struct("rank", "url", "id")).alias("best"))
    return wanted.select("ref").join(best, "ref", "left").select("ref", F.col("best.id").alias("id"), F.col("best.url").alias("url"))


def show(resolved: DataFrame, content: DataFrame) -> DataFrame:
    """The content rows of resolved references, in order."""
    rows = resolved.where("id IS NOT NULL").select("ref", "id").join(content.select("id", "chunk_index", "content_rowid", "title", "body"), "id")
    return rows.select("ref", "id", "chunk_index", "content_rowid", "title", "body")
