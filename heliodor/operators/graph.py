"""The document graph: edges, the resumable frontier and its closure."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.functions.docjson import json_references
from heliodor.functions.text import url_id
from heliodor.session import materialise


def edges(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url, title) of pages (url, payload), repeats kept."""
    refs = pages.where("payload IS NOT NULL").select(F.col("url").alias("src_url"), F.explode(json_references("payload")).alias("ref"))
    return refs.select("src_url", F.col("ref.url").alias("dst_url"), F.col("ref.title").alias("title"))


def frontier(manifest: DataFrame, progress: DataFrame) -> DataFrame:
    """Doc pages that weren't processed yet; failed ones come again."""
    done = progress.where("status = 'processed'").select("url")
    return manifest.where("type = 'doc'").join(done, "url", "left_anti").select("id", "url")


def processed_count(manifest: DataFrame, progress: DataFrame) -> DataFrame:
    """How many doc pages are processed; a page recorded several times counts once."""
    done = progress.where("status = 'processed'").select("url").distinct()
    return manifest.where("type = 'doc'").join(done, "url", "left_semi").agg(F.count("*").alias("processed"))


def reference_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("src_url").alias("url")).agg(F.count("*").alias("refs_found"))


def discovered(edge: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of the linked pages that aren't known: one hop, one row a page, the first title in order."""
    new = edge.join(manifest.select(F.col("url").alias("dst_url")), "dst_url", "left_anti")
    rows = new.groupBy("dst_url").agg(F.min("title").alias("title"))
    return rows.select(url_id(F.col("dst_url")).alias("id"), F.lit("doc").alias("type"), F.col("dst_url").alias("url"), F.lit("doc-graph").alias("source"), F.lit("discovered").alias("status"), "title")


def closure(edge: DataFrame, start: DataFrame) -> DataFrame:
    """(url, hops) of all pages that `start` (url) reaches, hop by hop until none is new. Each hop is written, so lineage doesn't grow."""
    links = materialise(edge.select("src_url", "dst_url").distinct(), "edges")
    seen = materialise(start.select("url").distinct().withColumn("hops", F.lit(0)), "hop")
    last = seen
    for hop in count(1):
        step = links.join(last.select(F.col("url").alias("src_url")), "src_url", "left_semi").select(F.col("dst_url").alias("url")).distinct()
        last = materialise(step.join(seen.select("url"), "url", "left_anti").withColumn("hops", F.lit(hop)), "hop")
        if last.isEmpty():
            break
        seen = seen.unionAll(last)
        if hop % 16 == 0:  # so that the plan doesn't grow either
            seen = materialise(seen, "hops")
    return seen
