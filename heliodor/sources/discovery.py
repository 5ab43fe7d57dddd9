"""Discovery: listing pages and reference maps into manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodor.functions.docjson import json_references
from heliodor.functions.text import SITE, links, session_links, title_from_path, url_id
from heliodor.operators.manifest import merge_discoveries


def _rows(found: DataFrame, type_: str, source: str, title: Column) -> DataFrame:
    return found.select(url_id(F.col("url")).alias("id"), F.lit(type_).alias("type"), "url", F.lit(source).alias("source"), F.lit("discovered").alias("status"), title.alias("title")).distinct()


def session_index(pages: DataFrame, site: str = SITE, prefix: str = "/videos/play/", name: str = "WWDC") -> DataFrame:
    """Talks linked from listing pages (html); the title, of year and number, is a stand-in until the talk is fetched."""
    found = pages.select(F.explode(session_links(F.col("html"), prefix)).alias("path")).select(F.concat(F.lit(site), "path").alias("url"))
    return _rows(found, "talk", "wwdc", F.concat(F.lit(name), F.regexp_extract("url", r"(\d+)/\d+/?$", 1), F.lit(" Session "), F.regexp_extract("url", r"/(\d+)/?$", 1)))


def hub(pages: DataFrame, site: str = SITE) -> DataFrame:
    """Documentation pages linked from hub pages (html)."""
    found = pages.select(F.explode(links(F.col("html"))).alias("path")).select("path", F.concat(F.lit(site), "path").alias("url"))
    return _rows(found, "doc", "whats-new", title_from_path(F.col("path")))


def reference_map(payloads: DataFrame, type_: str, source: str) -> DataFrame:
    """Pages named in the references of JSON (payload): technologies as docs, a sample library as samples."""
    found = payloads.select(F.explode(json_references("payload")).alias("r")).select("r.url", "r.title")
    return _rows(found.groupBy("url").agg(F.min("title").alias("title")), type_, source, F.col("title"))


def discover(sessions: DataFrame, hubs: DataFrame, technologies: DataFrame, graph: DataFrame, samples: DataFrame) -> DataFrame:
    """All sources together; a page found by several belongs to the one that is asked first."""
    rows = session_index(sessions).unionByName(hub(hubs)).unionByName(reference_map(technologies, "doc", "technologies")).unionByName(graph).unionByName(reference_map(samples, "sample", "sample-library"))
    return merge_discoveries(rows)
