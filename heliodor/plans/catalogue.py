"""All core queries by name, and the SQL that the results of most of them are checked against.

Queries that SQL can't express (hashed embeddings, snippets) have none and are tested on fixtures. Pages, JSON and archives, which no
table holds, are made from whole tables: one for each resource or code file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.functions import archives, chunking, docjson, text
from heliodor.operators import embedding, graph, incremental, manifest, resolve, search, status
from heliodor.sources import discovery, raw
from heliodor.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_found": incremental.p7_found}
SQL: dict[str, str] = {"p7_found": incremental.P7_FOUND_SQL}

NOW = 1_960_000_000_000
SITE = text.SITE


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- statistics -------------------------------------------------------------------------------------------------------------


@query("status_by_type", "SELECT type, count(*) AS n FROM manifest GROUP BY type")
def _(spark, root):
    return status.counts(read(spark, root, "manifest"), "type")


@query("status_by_status", "SELECT status, count(*) AS n FROM manifest GROUP BY status")
def _(spark, root):
    return status.counts(read(spark, root, "manifest"), "status")


@query("status_totals", "SELECT (SELECT count(*) FROM manifest) AS resources, count(*) AS chunks, count(DISTINCT id) AS items FROM content")
def _(spark, root):
    return status.totals(read(spark, root, "manifest"), read(spark, root, "content"))


@query("status_map", """SELECT '{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}' AS counts FROM (SELECT status, count(*) AS n FROM manifest WHERE status IS NOT NULL GROUP BY status)""")
def _(spark, root):
    return status.counts_map(read(spark, root, "manifest"), "status")


@query("recent_failures", "SELECT DISTINCT url, error, processed_at FROM doc_graph_progress WHERE status = 'failed' ORDER BY processed_at DESC, url, error LIMIT 10")
def _(spark, root):
    return status.recent_failures(read(spark, root, "doc_graph_progress"))


@query("run_outcomes", "SELECT run_id, coalesce(outcome, 'unknown') AS outcome, count(DISTINCT log_id) AS n FROM process_log GROUP BY 1, 2")
def _(spark, root):
    return status.outcomes(read(spark, root, "process_log"))


@query("relational_pricing", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def _(spark, root):
    rows = read(spark, root, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query("relational_orders_by_nation", """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(spark, root):
    customers = read(spark, root, "customer").join(read(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read(spark, root, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- ids, hashes and text ---------------------------------------------------------------------------------------------------


@query("url_ids", "SELECT id, left(sha256(url), 16) AS computed FROM manifest")
def _(spark, root):
    return read(spark, root, "manifest").select("id", text.url_id(F.col("url")).alias("computed"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, root):
    return read(spark, root, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{text.WS}+|{text.WS}+$', '', 'g')"


def sql_html(x: str) -> str:
    """The conversion of pages, written out by hand."""
    line = r"[^\n\r\x{2028}\x{2029}]*?"
    for tag in ("script", "style"):
        x = rf"regexp_replace({x}, '<{tag}[^>]*>[\s\S]*?</{tag}>', '', 'gi')"
    for start, before, after in (("h1", "# ", 1), ("h2", "## ", 1), ("h3", "### ", 1), ("p", "", 2), ("li", "- ", 1)):
        x = rf"regexp_replace({x}, '<{start}[^>]*>({line})</{start}>', '{before}\1' || repeat(chr(10), {after}) || '', 'gi')"
    x = rf"regexp_replace(regexp_replace({x}, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
    x = f"replace(replace(replace({x}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<')"
    x = f"replace(replace(replace({x}, '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39))"
    x = rf"regexp_replace({x}, '\n{text.WS}*\n{text.WS}*\n', chr(10) || chr(10), 'g')"
    return f"nullif({sql_trim(x)}, '')"


@query("html_to_text", f"SELECT doc_id, {sql_html('text')} AS plain FROM documents")
def _(spark, root):
    return read(spark, root, "documents").select("doc_id", text.html_to_text(F.col("text")).alias("plain"))


@query("first_line_titles", f"""SELECT content_rowid, nullif({sql_trim(f"regexp_replace(split_part(body, chr(10), 1), '^#+{text.WS}*', '')")}, '') AS first_line FROM content""")
def _(spark, root):
    return read(spark, root, "content").select("content_rowid", text.first_line(F.col("body")).alias("first_line"))


@query("content_titles", f"""SELECT content_rowid, coalesce(m.title, nullif({sql_trim(f"regexp_replace(split_part(c.body, chr(10), 1), '^#+{text.WS}*', '')")}, ''), 'Untitled') AS title FROM content c LEFT JOIN manifest m ON c.id = m.id""")
def _(spark, root):
    m = read(spark, root, "manifest").select("id", F.col("title").alias("given"))
    return read(spark, root, "content").select("content_rowid", "id", "body").join(m, "id", "left").select("content_rowid", F.coalesce("given", text.first_line(F.col("body")), F.lit("Untitled")).alias("title"))


_SQL_TITLE = r"""array_to_string(list_transform(regexp_extract_all(replace(CASE WHEN split_part(url, '/', -1) = '' THEN split_part(url, '/', -2) ELSE split_part(url, '/', -1) END, '-', ' '), '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1), lambda p: upper(p[1:1]) || p[2:]), '')"""


@query("titles_from_paths", f"SELECT id, {_SQL_TITLE} AS title FROM manifest")
def _(spark, root):
    return read(spark, root, "manifest").select("id", text.title_from_path(F.col("url")).alias("title"))


@query("archive_titles", rf"""SELECT DISTINCT zip, {sql_trim(r"regexp_replace(regexp_replace(zip, '\.zip$', ''), '([A-Z])', ' \1', 'g')")} AS title
  FROM (SELECT regexp_extract(url, '/([^/#]+\.zip)', 1) AS zip FROM manifest) WHERE zip <> ''""")
def _(spark, root):
    zips = read(spark, root, "manifest").select(F.regexp_extract("url", r"/([^/#]+\.zip)", 1).alias("zip")).where("zip <> ''").distinct()
    return zips.select("zip", text.archive_title(F.col("zip")).alias("title"))


@query("breadcrumbs", r"""WITH p AS (SELECT id, string_split(regexp_extract(url, '/documentation/([^\n\r]+)$', 1), '/') AS s FROM manifest WHERE regexp_matches(url, '/documentation/[^\n\r]+$'))
  SELECT id, i AS level, s[i] AS name, '/documentation/' || array_to_string(s[1:i], '/') AS path FROM (SELECT id, s, unnest(range(1, len(s))) AS i FROM p)""")
def _(spark, root):
    rows = read(spark, root, "manifest").select("id", F.posexplode(text.breadcrumbs(F.col("url"))).alias("level", "b"))
    return rows.select("id", (F.col("level") + 1).cast("bigint").alias("level"), "b.name", "b.path")


def sql_source(path: str) -> str:
    ext = f"lower(regexp_extract(split_part({path}, '/', -1), '[^.][^/]*?(\\.[^./]*)$', 1))"
    allowed = ", ".join(f"'{e}'" for e in text.SOURCE_EXTENSIONS)
    folders = " AND ".join(f"NOT contains({path}, '{f}')" for f in text.BUILD_FOLDERS)
    names = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in text.LANGUAGE_NAMES.items())
    return f"{ext} IN ({allowed}) AND NOT starts_with(split_part({path}, '/', -1), '.') AND {folders} AS is_source, CASE {ext} {names} ELSE '' END AS language"


@query("code_file_paths", f"SELECT content_rowid, path, {sql_source('path')} FROM (SELECT content_rowid, CASE WHEN instr(url, '#') > 0 THEN substr(url, instr(url, '#') + 1) ELSE '' END AS path FROM content WHERE type = 'code_file')")
def _(spark, root):
    rows = read(spark, root, "content").where("type = 'code_file'").select("content_rowid", text.split_code_url(F.col("url")).alias("path"))
    return rows.select("content_rowid", "path", text.is_source_file(F.col("path")).alias("is_source"), text.language_of(F.col("path")).alias("language"))


@query("truncated_sources", "SELECT content_rowid, CASE WHEN length(body) > 5000 THEN left(body, 5000) || chr(10) || '// ... (truncated)' ELSE body END AS shown FROM content WHERE type = 'code_file'")
def _(spark, root):
    return read(spark, root, "content").where("type = 'code_file'").select("content_rowid", text.truncate_source(F.col("body")).alias("shown"))


def sql_bytes(n: str) -> str:
    cases = " ".join(f"WHEN {n} >= {1024**p} THEN (({n} * 10 + {1024**p // 2}) // {1024**p} // 10)::VARCHAR || '.' || (({n} * 10 + {1024**p // 2}) // {1024**p} % 10)::VARCHAR || ' {u}'" for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    return f"CASE {cases} ELSE {n}::VARCHAR || ' B' END"


@query("format_bytes", f"SELECT doc_id, {sql_bytes('(n_chars * n_chars)')} AS size FROM documents")
def _(spark, root):
    return read(spark, root, "documents").select("doc_id", text.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("progress_points", """SELECT log_id, run_id, processed, total > 0 AND (processed = 1 OR processed = total OR processed % 100 = 0 OR waited >= 10000) AS told
  FROM (SELECT DISTINCT log_id, run_id, log_id % 250 AS processed, 200 AS total, log_id % 10007 AS waited FROM process_log)""")
def _(spark, root):
    rows = read(spark, root, "process_log").select("log_id", "run_id").distinct().withColumn("processed", F.col("log_id") % 250)
    return rows.select("log_id", "run_id", "processed", text.logs_progress(F.col("processed"), F.lit(200), F.col("log_id") % 10007, F.lit(0)).alias("told"))


@query("retryable_errors", """SELECT url, error, coalesce(NOT contains(lower(error), 'redirect') AND (contains(error, 'fetch failed') OR contains(error, 'ECONNRESET') OR contains(error, 'ETIMEDOUT') OR contains(error, 'ENOTFOUND') OR contains(error, 'socket hang up')), false) AS retry
  FROM (SELECT DISTINCT url, error FROM doc_graph_progress)""")
def _(spark, root):
    return read(spark, root, "doc_graph_progress").select("url", "error").distinct().withColumn("retry", text.is_retryable(F.col("error")))


@query("retry_delays", """SELECT url, attempt, (1000 * 2 ** attempt)::BIGINT AS delay_ms FROM (SELECT DISTINCT url FROM doc_graph_progress WHERE status = 'failed'), (SELECT unnest([0, 1, 2]) AS attempt)""")
def _(spark, root):
    failed = read(spark, root, "doc_graph_progress").where("status = 'failed'").select("url").distinct()
    tries = failed.select("url", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"))
    return tries.select("url", "attempt", text.retry_delay(F.col("attempt")).alias("delay_ms"))


@query("doc_endpoints", rf"""SELECT id, '{SITE}/tutorials/data/documentation/' || p || '.json' AS primary_url, '{SITE}/documentation/' || p || '/data.json' AS fallback_url
  FROM (SELECT id, regexp_extract(url, '/documentation/([^\n\r]+?)/?$', 1) AS p FROM manifest WHERE type = 'doc')""")
def _(spark, root):
    primary, fallback = text.doc_endpoints(F.col("url"))
    return read(spark, root, "manifest").where("type = 'doc'").select("id", primary.alias("primary_url"), fallback.alias("fallback_url"))


_SQL_PATH = f"CASE WHEN starts_with(url, '{SITE}/') THEN substr(url, {len(SITE) + 1}) ELSE '/elsewhere' END"
#: A page for each resource: two links to it, a link to a talk, its title.
_SQL_PAGES = f"""(SELECT id AS page, '<TITLE> ' || coalesce(title, '') || ' - Docs</TITLE><a href="' || {_SQL_PATH} || '">A</a> <p><a href="' || {_SQL_PATH} || '/">B</a> <a href="/videos/play/conf'
  || (2019 + ascii(right(id, 1)) % 6)::VARCHAR || '/' || (100 + ascii(id))::VARCHAR || '/">V</a>' AS html FROM manifest)"""


def _pages(spark: SparkSession, root: str) -> DataFrame:
    """The same pages as columns."""
    path = F.when(F.col("url").startswith(f"{SITE}/"), F.substring("url", len(SITE) + 1, 1_000_000)).otherwise("/elsewhere")
    year, number = (F.lit(2019) + F.ascii(F.right("id", F.lit(1))) % 6).cast("string"), (F.lit(100) + F.ascii("id")).cast("string")
    html = F.concat(F.lit("<TITLE> "), F.coalesce("title", F.lit("")), F.lit(' - Docs</TITLE><a href="'), path, F.lit('">A</a> <p><a href="'), path, F.lit('/">B</a> <a href="/videos/play/conf'), year, F.lit("/"), number, F.lit('/">V</a>'))
    return read(spark, root, "manifest").select(F.col("id").alias("page"), html.alias("html"))


@query("page_links", rf"""SELECT page, pos, link, count(*) OVER (PARTITION BY page, link) AS times, row_number() OVER (PARTITION BY page, link ORDER BY pos) AS nth
  FROM (SELECT page, i AS pos, regexp_replace(l[i], '/$', '') AS link FROM (SELECT page, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page, regexp_extract_all(html, 'href="(/documentation/[^"]+)"', 1) AS l FROM {_SQL_PAGES})))""")
def _(spark, root):
    pages = _pages(spark, root)
    rows = pages.select("page", F.posexplode(text.links(F.col("html"))).alias("pos", "link")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    times = rows.groupBy("page", "link").agg(F.count("*").alias("times"))
    return manifest.ordinal(rows, ["page", "link"], [F.col("pos")], "nth").withColumn("nth", F.col("nth").cast("bigint")).join(times, ["page", "link"])


@query("session_links", rf"""SELECT DISTINCT page, unnest(regexp_extract_all(html, 'href="(/videos/play/[a-z]+\d+/\d+/)"', 1)) AS link FROM {_SQL_PAGES}""")
def _(spark, root):
    return _pages(spark, root).select("page", F.explode(text.session_links(F.col("html"))).alias("link"))


@query("page_titles", rf"""SELECT page, {sql_trim("regexp_replace(nullif(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1), ''), ' - Docs$', '')")} AS title FROM {_SQL_PAGES}""")
def _(spark, root):
    return _pages(spark, root).select("page", text.page_title(F.col("html"), " - Docs").alias("title"))


@query("transcript_format", rf"""WITH w AS (SELECT DISTINCT id, transcript, regexp_extract(transcript, '\d+:\d+') AS mark FROM wwdc_content)
  SELECT id, CASE WHEN mark <> '' THEN {sql_trim(r"regexp_replace(substr(transcript, instr(transcript, mark)), '(\d+:\d+)([A-Za-z])', chr(10) || chr(10) || '\1 \2', 'g')")}
    ELSE {sql_trim("transcript")} END AS formatted FROM w""")
def _(spark, root):
    return read(spark, root, "wwdc_content").select("id", "transcript").distinct().select("id", text.format_transcript(F.col("transcript")).alias("formatted"))


@query("talk_markdown", """SELECT DISTINCT id, concat_ws(chr(10), '# ' || coalesce(nullif(title, ''), 'Untitled Session'), chr(10) || 'URL: ' || url || chr(10),
    CASE WHEN coalesce(description, '') <> '' THEN '## Description' || chr(10) || chr(10) || description || chr(10) END,
    CASE WHEN coalesce(transcript, '') <> '' THEN '## Transcript' || chr(10) || chr(10) || transcript || chr(10) END,
    CASE WHEN len(resources) > 0 THEN '## Resources' || chr(10) || chr(10) || array_to_string(list_transform(resources, lambda r: '- ' || coalesce(r, 'null')), chr(10)) END) AS markdown FROM wwdc_content""")
def _(spark, root):
    rows = read(spark, root, "wwdc_content")
    return rows.select("id", text.talk_markdown(*(F.col(c) for c in ("title", "url", "description", "transcript", "resources"))).alias("markdown")).distinct()


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, root):
    return read(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _last(needle: str) -> str:
    """Where `needle` begins last, at or before the limit, from 0; -1 if nowhere."""
    head, size = f"left(rest, {chunking.MOST} + {len(needle)})", len(needle)
    n = "'" + needle + "'" if needle.strip() or needle == " " else " || ".join(["chr(10)"] * size)
    back = "'" + needle[::-1] + "'" if needle.strip() or needle == " " else n
    return f"CASE WHEN instr({head}, {n}) = 0 THEN -1 ELSE length({head}) - {size} - (instr(reverse({head}), {back}) - 1) END"


def _chunks_sql() -> str:
    """The chunker as a recursive query: each step cuts a chunk off and goes on with the rest."""
    cut = f"CASE WHEN p2 > 5000 THEN p2 + 2 WHEN p1 > 5000 THEN p1 + 1 WHEN ps > 5000 THEN ps + 2 WHEN pw > 5000 THEN pw + 1 ELSE {chunking.MOST} END"
    places = f"SELECT *, {_last(chr(10) * 2)} AS p2, {_last(chr(10))} AS p1, greatest({_last('. ')}, {_last('! ')}, {_last('? ')}) AS ps, {_last(' ')} AS pw FROM {{}}"
    step = f"SELECT doc_id, no, rest, length(rest) > {chunking.MOST} AS long, {cut} AS cut FROM ({places})"
    return f"""WITH RECURSIVE r AS (
      {step.format("(SELECT doc_id, 0 AS no, text AS rest FROM documents WHERE text IS NOT NULL) a")}
      UNION ALL
      {step.format(f"(SELECT doc_id, no + 1 AS no, {sql_trim('substr(rest, cut + 1)')} AS rest FROM r WHERE long) a WHERE rest <> ''")})
    SELECT doc_id, no AS chunk_index, CASE WHEN long THEN {sql_trim("left(rest, cut)")} ELSE rest END AS chunk FROM r"""


@query("chunk_documents", _chunks_sql())
def _(spark, root):
    return chunking.chunk_table(read(spark, root, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("chunk_stats", f"SELECT chunk_index, count(*) AS n, max(length(chunk)) AS longest, sum(length(chunk))::BIGINT AS chars FROM ({_chunks_sql()}) GROUP BY chunk_index")
def _(spark, root):
    rows = chunking.chunk_table(read(spark, root, "documents"), "doc_id", "text").withColumn("n_chars", F.char_length("chunk").cast("bigint"))
    return rows.groupBy("chunk_index").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.sum("n_chars").alias("chars"))


# --- manifest and graph -----------------------------------------------------------------------------------------------------


@query("manifest_insert_ignore", """WITH old AS (SELECT id, type, url, source, status FROM manifest WHERE status <> 'discovered'),
  new AS (SELECT DISTINCT left(sha256(url), 16) AS id, 'doc' AS type, url, 'doc-graph' AS source, 'discovered' AS status FROM doc_graph_progress WHERE url IS NOT NULL)
  SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old) AND url NOT IN (SELECT url FROM old)""")
def _(spark, root):
    old = read(spark, root, "manifest").where("status <> 'discovered'").select("id", "type", "url", "source", "status")
    new = read(spark, root, "doc_graph_progress").select(text.url_id(F.col("url")).alias("id"), F.lit("doc").alias("type"), "url", F.lit("doc-graph").alias("source"), F.lit("discovered").alias("status"))
    return manifest.insert_ignore(old, new)


@query("manifest_upsert", """WITH new AS (SELECT DISTINCT id, 'indexed' AS status FROM process_log WHERE outcome = 'done' AND id IS NOT NULL)
  SELECT id, status FROM manifest WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, status FROM new""")
def _(spark, root):
    new = read(spark, root, "process_log").where("outcome = 'done' AND id IS NOT NULL").select("id", F.lit("indexed").alias("status")).distinct()
    return manifest.upsert(read(spark, root, "manifest").select("id", "status"), new, "id")


@query("manifest_patch", """WITH new AS (SELECT id, max(etag) AS etag FROM process_log WHERE outcome = 'done' GROUP BY id) SELECT m.id, coalesce(n.etag, m.etag) AS etag, m.title FROM manifest m LEFT JOIN new n ON m.id = n.id""")
def _(spark, root):
    new = read(spark, root, "process_log").where("outcome = 'done'").groupBy("id").agg(F.max("etag").alias("etag"))
    return manifest.patch(read(spark, root, "manifest").select("id", "etag", "title"), new, "id", ["etag"])


@query("manifest_refresh_all", "SELECT id, CASE WHEN fetched_at IS NOT NULL THEN 'discovered' ELSE status END AS status FROM manifest")
def _(spark, root):
    return manifest.refresh(read(spark, root, "manifest"), NOW, None).select("id", "status")


@query("manifest_refresh_stale", f"SELECT id, CASE WHEN fetched_at IS NOT NULL AND fetched_at < {NOW - manifest.YEAR_MS} THEN 'discovered' ELSE status END AS status FROM manifest")
def _(spark, root):
    return manifest.refresh(read(spark, root, "manifest"), NOW).select("id", "status")


@query("manifest_violations", """WITH m AS (SELECT id, type, url, status FROM manifest UNION ALL SELECT id, 'hub', url, NULL FROM seeds UNION ALL SELECT id, 'doc', url, 'indexed' FROM seeds)
  SELECT 'duplicate id' AS rule, id AS value FROM m GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate url', url FROM m GROUP BY url HAVING count(*) > 1
  UNION ALL SELECT 'bad type', id FROM m WHERE type IS NULL OR type NOT IN ('doc', 'talk', 'sample', 'code_file') UNION ALL SELECT 'bad status', id FROM m WHERE status IS NULL OR status NOT IN ('discovered', 'fetched', 'normalized', 'indexed', 'failed')""")
def _(spark, root):
    """The manifest's rules over itself and the hub pages, put in twice: once with a type and a status that aren't allowed."""
    seeds = read(spark, root, "seeds").select("id", "url")
    rows = read(spark, root, "manifest").select("id", "type", "url", "status")
    bad = seeds.select("id", F.lit("hub").alias("type"), "url", F.lit(None).cast("string").alias("status"))
    good = seeds.select("id", F.lit("doc").alias("type"), "url", F.lit("indexed").alias("status"))
    return manifest.violations(rows.unionByName(bad).unionByName(good))


@query("fetchable", """SELECT id, url, CASE WHEN status <> 'failed' THEN etag END AS etag, CASE WHEN status <> 'failed' THEN last_modified END AS last_modified,
  CASE source WHEN 'wwdc' THEN 1 WHEN 'whats-new' THEN 2 WHEN 'doc-graph' THEN 3 WHEN 'sample-library' THEN 4 ELSE 5 END AS priority FROM manifest WHERE status IN ('discovered', 'failed')""")
def _(spark, root):
    return manifest.fetchable(read(spark, root, "manifest")).select("id", "url", "etag", "last_modified", "priority")


@query("source_priority_order", """SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY CASE source WHEN 'wwdc' THEN 1 WHEN 'whats-new' THEN 2 WHEN 'doc-graph' THEN 3 WHEN 'sample-library' THEN 4 ELSE 5 END, url)::BIGINT AS nth FROM manifest WHERE status IN ('discovered', 'failed')""")
def _(spark, root):
    rows = manifest.fetchable(read(spark, root, "manifest"))
    return manifest.ordinal(rows, ["type"], [F.col("priority"), F.col("url")], "nth").select("id", "type", F.col("nth").cast("bigint").alias("nth"))


@query("merge_discoveries", """SELECT id, url, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE source WHEN 'wwdc' THEN 1 WHEN 'whats-new' THEN 2 WHEN 'technologies' THEN 3 WHEN 'doc-graph' THEN 4 WHEN 'sample-library' THEN 5 ELSE 99 END, id) AS rn
  FROM (SELECT id, url, source FROM manifest UNION ALL SELECT id, url, source FROM seeds UNION ALL SELECT left(sha256(url), 16), url, 'doc-graph' FROM doc_graph_progress) WHERE url IS NOT NULL) WHERE rn = 1""")
def _(spark, root):
    crawl = read(spark, root, "doc_graph_progress").select(text.url_id(F.col("url")).alias("id"), "url", F.lit("doc-graph").alias("source"))
    return manifest.merge_discoveries(read(spark, root, "manifest").select("id", "url", "source").unionAll(read(spark, root, "seeds").select("id", "url", "source")).unionAll(crawl))


@query("delete_with_vectors", """WITH gone AS (SELECT content_rowid FROM content WHERE id IN (SELECT id FROM manifest WHERE status = 'failed')), dead AS (SELECT vec_rowid FROM content_vec_map WHERE content_rowid IN (SELECT content_rowid FROM gone))
  SELECT 'content' AS part, content_rowid AS rowid FROM content WHERE id NOT IN (SELECT id FROM manifest WHERE status = 'failed') UNION ALL SELECT 'vector', vec_rowid FROM content_vec WHERE vec_rowid NOT IN (SELECT vec_rowid FROM dead)
  UNION ALL SELECT 'map', content_rowid FROM content_vec_map WHERE content_rowid NOT IN (SELECT content_rowid FROM gone)""")
def _(spark, root):
    ids = read(spark, root, "manifest").where("status = 'failed'")
    content, mapping, vectors = manifest.delete_with_vectors(ids, read(spark, root, "content").select("id", "content_rowid"), read(spark, root, "content_vec_map"), read(spark, root, "content_vec").select("vec_rowid"))
    part = lambda df, name, c: df.select(F.lit(name).alias("part"), F.col(c).alias("rowid"))
    return part(content, "content", "content_rowid").unionAll(part(vectors, "vector", "vec_rowid")).unionAll(part(mapping, "map", "content_rowid"))


@query("graph_frontier", "SELECT id, url FROM manifest WHERE type = 'doc' AND url NOT IN (SELECT url FROM doc_graph_progress WHERE status = 'processed' AND url IS NOT NULL)")
def _(spark, root):
    return graph.frontier(read(spark, root, "manifest"), read(spark, root, "doc_graph_progress"))


@query("graph_processed", "SELECT count(*) AS processed FROM manifest WHERE type = 'doc' AND url IN (SELECT url FROM doc_graph_progress WHERE status = 'processed')")
def _(spark, root):
    return graph.processed_count(read(spark, root, "manifest"), read(spark, root, "doc_graph_progress"))


def _site_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges from each documentation page to the page below it."""
    parts = F.split(F.regexp_extract("url", r"^(.*?)(/documentation/.+)$", 2), "/")
    rows = read(spark, root, "manifest").where("url LIKE '%/documentation/%'").select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(3), F.size("p") - 1)).alias("i"))
    at = lambda n: F.concat(F.lit(SITE), F.array_join(F.slice("p", 1, n), "/"))
    return rows.where(F.col("i") < F.size("p")).select(at(F.col("i")).alias("src_url"), at(F.col("i") + 1).alias("dst_url"))


_EDGES = rf"""e AS (SELECT '{SITE}' || array_to_string(p[1:i], '/') AS src_url, '{SITE}' || array_to_string(p[1:i + 1], '/') AS dst_url FROM (SELECT p, unnest(range(3, len(p))) AS i
  FROM (SELECT string_split(regexp_extract(url, '^(.*?)(/documentation/.+)$', 2), '/') AS p FROM manifest WHERE url LIKE '%/documentation/%')))"""


@query("reference_counts", f"WITH {_EDGES} SELECT src_url AS url, count(*) AS refs_found FROM e GROUP BY src_url")
def _(spark, root):
    return graph.reference_counts(_site_edges(spark, root))


@query("graph_discovered", f"WITH {_EDGES} SELECT DISTINCT left(sha256(dst_url), 16) AS id, dst_url AS url FROM e WHERE dst_url NOT IN (SELECT url FROM manifest)")
def _(spark, root):
    return graph.discovered(_site_edges(spark, root).withColumn("title", F.lit(None).cast("string")), read(spark, root, "manifest")).select("id", "url")


@query("graph_closure", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src_url AS url, 0 AS hops FROM e WHERE NOT contains(substr(src_url, {len(SITE) + len("/documentation/") + 1}), '/')
  UNION SELECT e.dst_url, r.hops + 1 FROM r JOIN e ON e.src_url = r.url) SELECT url, min(hops) AS hops FROM r GROUP BY url""")
def _(spark, root):
    edge = _site_edges(spark, root)
    start = edge.where(~F.substr(F.col("src_url"), F.lit(len(SITE) + len("/documentation/") + 1)).contains("/")).select(F.col("src_url").alias("url"))
    return graph.closure(edge, start)


_REFS = f"""SELECT CASE ascii(right(id, 1)) % 5 WHEN 0 THEN id WHEN 1 THEN upper(url) WHEN 2 THEN url WHEN 3 THEN substr(url, {len(SITE) + 1}) ELSE 'doc://app' || substr(url, {len(SITE) + 1}) END AS ref FROM manifest UNION SELECT 'nothing'"""


@query("resolve_reference", f"""WITH refs AS ({_REFS}), w AS (SELECT ref, CASE WHEN regexp_full_match(ref, '[a-f0-9]{{16}}') THEN NULL WHEN starts_with(ref, 'doc://') THEN '{SITE}' || regexp_extract(ref, '^doc://[^/]+(.*)', 1)
    WHEN starts_with(ref, '/documentation/') THEN '{SITE}' || ref WHEN starts_with(ref, '{SITE}/') THEN ref END AS u FROM refs),
  c AS (SELECT ref, m.id, m.url, 1 AS rank FROM w JOIN manifest m ON w.u IS NULL AND m.id = w.ref UNION ALL SELECT ref, m.id, m.url, 2 FROM w JOIN manifest m ON m.url = w.u UNION ALL SELECT ref, m.id, m.url, 3 FROM w JOIN manifest m ON lower(m.url) = lower(w.u)),
  b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY rank, url, id) AS rn FROM c) SELECT w.ref, b.id, b.url FROM w LEFT JOIN b ON b.ref = w.ref AND b.rn = 1""")
def _(spark, root):
    read(spark, root, "manifest").createOrReplaceTempView("heliodor_manifest")
    return resolve.resolve(spark.sql(_REFS.replace("FROM manifest", "FROM heliodor_manifest")), read(spark, root, "manifest"))


@query("show_content", "SELECT m.url AS ref, c.id, c.chunk_index, c.content_rowid, c.title, c.body FROM manifest m JOIN content c ON c.id = m.id WHERE m.type = 'talk'")
def _(spark, root):
    m = read(spark, root, "manifest").where("type = 'talk'")
    return resolve.show(m.select(F.col("url").alias("ref"), "id"), read(spark, root, "content"))


# --- search -----------------------------------------------------------------------------------------------------------------


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({x}, '')), '{search.FOLD_FROM}', '{search.FOLD_TO}'), '([\p{{L}}\p{{N}}]+)', 1)"


_TOKENS = f"t AS (SELECT content_rowid AS rowid, type, {sql_tokens('title')} AS c0, {sql_tokens('body')} AS c1, {sql_tokens('type')} AS c2, {sql_tokens('platforms')} AS c3 FROM content)"


def sql_bm25(terms: list[search.Term], where: str = "TRUE", limit: int = 40) -> str:
    """BM25 from token lists; a phrase is counted in each column."""
    def matches(term: search.Term, c: str) -> str:
        tests = " AND ".join(f"starts_with({c}[i + {k}], '{tok}')" if term.prefix and k == len(term.tokens) - 1 else f"{c}[i + {k}] = '{tok}'" for k, tok in enumerate(term.tokens))
        return f"len(list_filter(range(1, len({c}) + 2 - {len(term.tokens)}), lambda i: {tests}))"

    hits = " UNION ALL ".join(f"SELECT rowid, {j} AS j, {' + '.join(matches(t, c) for c in ('c0', 'c1', 'c2', 'c3'))} AS f FROM t" for j, t in enumerate(terms))
    return f"""WITH {_TOKENS}, d AS (SELECT rowid, type, len(c0) + len(c1) + len(c2) + len(c3) AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d),
      h AS (SELECT * FROM ({hits}) WHERE f > 0), df AS (SELECT j, count(*) AS df FROM h GROUP BY j),
      sc AS (SELECT h.rowid, round(sum((CASE WHEN ln((s.n - df.df + 0.5) / (df.df + 0.5)) <= 0 THEN {search.LEAST_IDF} ELSE ln((s.n - df.df + 0.5) / (df.df + 0.5)) END) * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * d.dl / s.a))), 12) AS score
        FROM h JOIN df ON h.j = df.j JOIN d ON d.rowid = h.rowid, s WHERE {where} GROUP BY h.rowid)
      SELECT rowid, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, rowid)::INT AS fts_rank FROM sc ORDER BY fts_rank LIMIT {limit}"""


def _keyword(name: str, words: str, terms: list[tuple[tuple[str, ...], bool]], type_: str | None = None) -> None:
    """A keyword query, and its terms as the SQL has them, written out by hand: (tokens, whether the last is a prefix)."""
    where = f"d.type = '{type_}'" if type_ else "TRUE"

    @query(name, sql_bm25([search.Term(*t) for t in terms], where))
    def _(spark, root):
        stored = search.index_of(spark, root)
        return search.keyword_search(read(spark, root, "content"), words, 20, type_, stored.occurrences, sizes=stored.lengths).withColumn("score", F.round("score", 6))


_keyword("bm25_single", "it", [(("it",), False)])
_keyword("bm25_prefix", "deprec", [(("deprec",), True)])
_keyword("bm25_or", "deprecated shader lazily", [(("deprecated",), True), (("shader",), True), (("lazily",), True)])
_keyword("bm25_phrase", '"smooth toolbars"', [(("smooth", "toolbars"), False)])
_keyword("bm25_phrase_or_words", '"main thread" silent', [(("main", "thread"), False), (("silent",), True)])
_keyword("bm25_type_filter", "animate gesture", [(("animate",), True), (("gesture",), True)], "talk")
_keyword("bm25_marked_word", "what's new", [(("what", "s"), True), (("new",), True)])
_keyword("type_as_text", "sample", [(("sample",), True)])


@query("bm25_without_a_stored_index", sql_bm25([search.Term(("toolbars",), True)]))
def _(spark, root):
    """The same over the texts themselves, as for a table that is searched once."""
    return search.keyword_search(read(spark, root, "content"), "toolbars").withColumn("score", F.round("score", 6))


@query("token_stats", f"WITH {_TOKENS} SELECT rowid AS content_rowid, len(c1)::BIGINT AS tokens, len(list_distinct(c1))::BIGINT AS terms FROM t")
def _(spark, root):
    t = search.tokens(F.col("body"))
    return read(spark, root, "content").select("content_rowid", F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("terms"))


@query("doc_lengths", f"WITH {_TOKENS} SELECT rowid, (len(c0) + len(c1) + len(c2) + len(c3))::BIGINT AS dl FROM t")
def _(spark, root):
    return search.index_of(spark, root).lengths.withColumn("dl", F.col("dl").cast("bigint"))


@query("postings_top_terms", f"WITH {_TOKENS}, o AS (SELECT rowid, unnest(list_concat(list_concat(c0, c1), list_concat(c2, c3))) AS term FROM t) SELECT term, count(DISTINCT rowid) AS df, count(*) AS tf FROM o GROUP BY term ORDER BY df DESC, term LIMIT 50")
def _(spark, root):
    rows = search.postings(search.index_of(spark, root).occurrences).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return rows.orderBy(F.desc("df"), "term").limit(50)


@query("leading_snippets", "SELECT content_rowid, left(body, 200) || '...' AS snippet FROM content")
def _(spark, root):
    return read(spark, root, "content").select("content_rowid", search.leading_snippet(F.col("body")).alias("snippet"))


_QUERY_VECTOR = "SELECT embedding::DOUBLE[] AS q FROM content_vec WHERE len(embedding) = 384 ORDER BY vec_rowid LIMIT 1"


def _query_vector(spark: SparkSession, root: str) -> list[float]:
    """The vector that stands for a query's: that of the smallest id with full length."""
    return list(read(spark, root, "content_vec").where(F.size("embedding") == 384).orderBy("vec_rowid").limit(1).collect()[0]["embedding"])


def _knn_sql(function: str, k: int = 20, where: str = "TRUE") -> str:
    return f"SELECT vec_rowid, round({function}(embedding::DOUBLE[], q), 6) AS distance FROM content_vec, ({_QUERY_VECTOR}) WHERE len(embedding) = 384 AND {where} ORDER BY {function}(embedding::DOUBLE[], q), vec_rowid LIMIT {k}"


@query("knn_l2", _knn_sql("list_distance"))
def _(spark, root):
    return search.knn(read(spark, root, "content_vec"), _query_vector(spark, root), 20).withColumn("distance", F.round("distance", 6))


@query("knn_cosine", "SELECT vec_rowid, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM content_vec, (" + _QUERY_VECTOR + ") WHERE len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9), vec_rowid LIMIT 20")
def _(spark, root):
    rows = search.knn(read(spark, root, "content_vec"), _query_vector(spark, root), 60, "cosine").withColumn("r", F.round("distance", 9))
    return rows.orderBy("r", "vec_rowid").limit(20).select("vec_rowid", F.round("distance", 6).alias("distance"))


def _semantic_sql(type_: str | None = None, prefilter: bool = False) -> str:
    kept = f"SELECT content_rowid FROM content WHERE type = '{type_}'" if type_ else "SELECT content_rowid FROM content"
    before = f"vec_rowid IN (SELECT vec_rowid FROM content_vec_map WHERE content_rowid IN ({kept}))" if prefilter and type_ else "TRUE"
    return f"""WITH near AS (SELECT vec_rowid, list_distance(embedding::DOUBLE[], q) AS distance FROM content_vec, ({_QUERY_VECTOR}) WHERE len(embedding) = 384 AND {before} ORDER BY distance, vec_rowid LIMIT 80),
      hit AS (SELECT m.content_rowid AS rowid, min(distance) AS distance FROM (SELECT DISTINCT * FROM content_vec_map) m JOIN near USING (vec_rowid) WHERE m.content_rowid IN ({kept}) GROUP BY 1)
      SELECT rowid, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, rowid)::INT AS vec_rank FROM hit ORDER BY vec_rank LIMIT 40"""


def _semantic(name: str, type_: str | None, prefilter: bool) -> None:
    @query(name, _semantic_sql(type_, prefilter))
    def _(spark, root):
        rows = search.semantic_search(read(spark, root, "content"), read(spark, root, "content_vec"), read(spark, root, "content_vec_map"), _query_vector(spark, root), 20, type_, prefilter)
        return rows.withColumn("distance", F.round("distance", 6))


_semantic("semantic_search", None, False)
_semantic("knn_type_postfilter", "talk", False)
_semantic("knn_type_prefilter", "talk", True)

WORDS = "smooth toolbars deprecated"


def _hybrid_sql(keyword: bool, semantic: bool, by_document: bool = False) -> str:
    """Fusion of both lists; the best chunk of each item, if asked for."""
    best = "SELECT * FROM f ORDER BY score DESC, fts_rank ASC NULLS LAST, vec_rank ASC NULLS LAST LIMIT 20"
    if by_document:
        best = """SELECT f.* FROM (SELECT f.*, row_number() OVER (PARTITION BY c.id ORDER BY score DESC, f.rowid) AS nth FROM (SELECT * FROM f ORDER BY score DESC, fts_rank ASC NULLS LAST, vec_rank ASC NULLS LAST LIMIT 80) f
          JOIN content c ON c.content_rowid = f.rowid) f WHERE nth = 1 ORDER BY score DESC, rowid LIMIT 20"""
    words = [search.Term((w,), True) for w in ("smooth", "toolbars", "deprecated")]
    k = f"SELECT rowid, fts_rank FROM ({sql_bm25(words)}) WHERE {keyword}"
    v = f"SELECT rowid, vec_rank FROM ({_semantic_sql()}) WHERE {semantic}"
    return f"""WITH k AS ({k}), v AS ({v}), f AS (SELECT coalesce(k.rowid, v.rowid) AS rowid, fts_rank, vec_rank, coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0) AS score FROM k FULL OUTER JOIN v ON k.rowid = v.rowid),
      b AS ({best})
      SELECT b.rowid, c.id, c.title, c.type, c.url, round(score, 6) AS score, fts_rank, vec_rank FROM b JOIN content c ON c.content_rowid = b.rowid"""


def _hybrid(name: str, keyword_only: bool, semantic_only: bool) -> None:
    @query(name, _hybrid_sql(not semantic_only, not keyword_only))
    def _(spark, root):
        tables = [read(spark, root, t) for t in ("content", "content_vec", "content_vec_map")]
        stored = search.index_of(spark, root)
        rows = search.hybrid_search(*tables, WORDS, _query_vector(spark, root), 20, None, keyword_only, semantic_only, stored.occurrences, sizes=stored.lengths)
        return rows.drop("snippet").withColumn("score", F.round("score", 6))


_hybrid("hybrid_search", False, False)
_hybrid("hybrid_keyword_only", True, False)
_hybrid("hybrid_semantic_only", False, True)


@query("hybrid_by_document", _hybrid_sql(True, True, True))
def _(spark, root):
    tables, stored = [read(spark, root, t) for t in ("content", "content_vec", "content_vec_map")], search.index_of(spark, root)
    rows = search.hybrid_search(*tables, WORDS, _query_vector(spark, root), by_document=True, index=stored.occurrences, sizes=stored.lengths)
    return rows.drop("snippet").withColumn("score", F.round("score", 6))


@query("hybrid_snippets")
def _(spark, root):
    tables = [read(spark, root, t) for t in ("content", "content_vec", "content_vec_map")]
    stored = search.index_of(spark, root)
    return search.hybrid_search(*tables, WORDS, _query_vector(spark, root), index=stored.occurrences, sizes=stored.lengths)


@query("pending_embeddings", "SELECT content_rowid FROM content WHERE content_rowid NOT IN (SELECT content_rowid FROM content_vec_map)")
def _(spark, root):
    return embedding.pending(read(spark, root, "content"), read(spark, root, "content_vec_map")).select("content_rowid")


@query("orphan_vectors", "SELECT vec_rowid FROM content_vec WHERE vec_rowid NOT IN (SELECT vec_rowid FROM content_vec_map WHERE content_rowid IN (SELECT content_rowid FROM content))")
def _(spark, root):
    return embedding.orphans(read(spark, root, "content"), read(spark, root, "content_vec_map"), read(spark, root, "content_vec"))


@query("hash_embedder")
def _(spark, root):
    return embedding.embed(read(spark, root, "content"), read(spark, root, "content_vec_map"))


# --- JSON pages and archives: a page for each resource, an archive for each code file ----------------------------------------


def _json_pages(spark: SparkSession, root: str) -> DataFrame:
    """(url, title, payload): a JSON page for each resource. Its title, source and type are text, its reference names itself and a deeper page."""
    m = read(spark, root, "manifest")
    inline = lambda kind, **held: F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in held.items()))
    abstract = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("From "), F.coalesce("source", F.lit("nowhere")), F.lit(" ")).alias("text"), F.lit(None).cast("string").alias("code")), F.struct(F.lit("codeVoice").alias("type"), F.lit(None).cast("string").alias("text"), F.col("type").alias("code")))
    heading = F.struct(F.lit("heading").alias("type"), F.lit(3).alias("level"), F.array(inline("text", text=F.lit("Overview"))).alias("inlineContent"))
    paragraph = F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.array(inline("text", text=F.concat(F.lit("Status: "), F.coalesce("status", F.lit("none"))))).alias("inlineContent"))
    section = F.struct(F.lit("content").alias("kind"), F.array(heading, paragraph).alias("content"))
    path = F.when(F.col("url").startswith(f"{SITE}/"), F.substring("url", len(SITE) + 1, 1_000_000)).otherwise("/elsewhere")
    deep = F.array(F.struct(F.concat(F.lit("/documentation/deep/"), "id").alias("url"), F.lit("Deep").alias("title")))
    references = F.struct(F.struct(path.alias("url"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Named")).alias("title"), deep.alias("references")).alias("a"))
    page = F.struct(F.struct("title", abstract.alias("abstract")).alias("metadata"), F.array(section).alias("primaryContentSections"), references.alias("references"))
    return m.select("id", "type", "url", F.lit(None).cast("string").alias("title"), F.to_json(page).alias("payload"))


@query("json_to_markdown", """SELECT url, '# ' || coalesce(nullif(title, ''), 'Document') || chr(10) || chr(10) || 'From ' || coalesce(source, 'nowhere') || ' `' || type || '`' || chr(10) || chr(10)
  || '### Overview' || chr(10) || 'Status: ' || coalesce(status, 'none') || chr(10) || chr(10) || '---' || chr(10) || 'Source: ' || url AS markdown FROM manifest""")
def _(spark, root):
    return _json_pages(spark, root).select("url", F.coalesce(docjson.json_to_markdown("payload", "url", "title"), text.html_to_text(F.col("payload"))).alias("markdown"))


@query("json_references", f"""SELECT url AS src_url, url AS dst_url, coalesce(nullif(title, ''), 'Named') AS title FROM manifest WHERE starts_with(url, '{SITE}/documentation/')
  UNION ALL SELECT url, '{SITE}/documentation/deep/' || id, 'Deep' FROM manifest""")
def _(spark, root):
    return graph.edges(_json_pages(spark, root))


@query("sample_downloads", f"""SELECT id, 'Page ' || id AS title, CASE ascii(right(id, 1)) % 4 WHEN 1 THEN '{SITE}/assets/' || id || '.zip' WHEN 2 THEN 'https://elsewhere.example/' || id || '.zip' END AS download FROM manifest""")
def _(spark, root):
    """Pages whose download is inactive, active, at a full address, or without an identifier."""
    kind = F.ascii(F.right("id", F.lit(1))) % 4
    action = F.when(kind == 0, F.lit('"isActive": 0, "identifier": "x.zip"')).when(kind == 1, F.concat(F.lit('"isActive": true, "identifier": "'), "id", F.lit('.zip"'))).when(kind == 2, F.concat(F.lit('"isActive": "yes", "identifier": "https://elsewhere.example/'), "id", F.lit('.zip"'))).otherwise(F.lit('"isActive": true, "identifier": 7'))
    payload = F.concat(F.lit('{"metadata": {"title": "Page '), "id", F.lit('"}, "sampleCodeDownload": {"action": {'), action, F.lit("}}}"))
    pages = read(spark, root, "manifest").select("id", payload.alias("payload"))
    return pages.select("id", docjson.json_title(F.col("payload")).alias("title"), docjson.sample_download(F.col("payload"), f"{SITE}/assets/").alias("download"))


def _archives(spark: SparkSession, root: str) -> DataFrame:
    """(url, payload): an archive for each code file of the content, which also holds files that are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, body in zip(b["path"], b["body"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, data in ((path, body), ("docs/README.md", "# r"), ("App/.hidden.swift", "x"), ("x/.build/y.c", "int y;")):
                        z.writestr(zipfile.ZipInfo(name), data)
                out.append(held.getvalue())
            yield pd.DataFrame({"url": b["url"], "payload": out})

    files = read(spark, root, "content").where("type = 'code_file' AND body IS NOT NULL").select(F.concat(F.lit(f"{SITE}/archives/"), F.col("content_rowid").cast("string"), F.lit(".zip")).alias("url"), text.split_code_url(F.col("url")).alias("path"), "body")
    return files.where("path <> ''").mapInPandas(pack, "url string, payload binary")


_SQL_FILES = f"(SELECT '{SITE}/archives/' || content_rowid || '.zip' AS url, path, body, {sql_source('path')} FROM (SELECT *, substr(url, instr(url, '#') + 1) AS path FROM content WHERE type = 'code_file' AND instr(url, '#') > 0 AND body IS NOT NULL))"


@query("archive_files", f"SELECT left(sha256(url || '#' || path), 16) AS id, url, path, body AS content FROM {_SQL_FILES} WHERE is_source")
def _(spark, root):
    return archives.source_files(archives.entries(_archives(spark, root), "url", "payload").withColumnRenamed("key", "url"), "url").select("id", "url", "path", "content")


@query("archive_summary", f"""SELECT url, '# A' || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || '## Source Files (1)' || chr(10) || chr(10) || '### ' || path || chr(10) || chr(10) || '```' || language || chr(10)
  || CASE WHEN length(body) > 5000 THEN left(body, 5000) || chr(10) || '// ... (truncated)' ELSE body END || chr(10) || '```' || chr(10) || chr(10) AS markdown FROM {_SQL_FILES} WHERE is_source""")
def _(spark, root):
    return archives.summary(QUERIES["archive_files"](spark, root).withColumn("title", F.lit("A")), ["url"], "title", "url").select("url", "markdown")


# --- discovery and fetching ---------------------------------------------------------------------------------------------------


@query("discover_sources", rf"""WITH talks AS (SELECT DISTINCT 2019 + ascii(right(id, 1)) % 6 AS y, 100 + ascii(id) AS n FROM manifest),
  docs AS (SELECT DISTINCT url, {_SQL_TITLE} AS title FROM manifest WHERE starts_with(url, '{SITE}/documentation/')),
  f AS (SELECT 'talk' AS type, '{SITE}/videos/play/conf' || y || '/' || n || '/' AS url, 'wwdc' AS source, 'WWDC' || y || ' Session ' || n AS title FROM talks
    UNION ALL SELECT 'doc', url, 'whats-new', title FROM docs UNION ALL SELECT 'doc', '{SITE}/documentation/deep/' || id, 'technologies', 'Deep' FROM manifest)
  SELECT left(sha256(url), 16) AS id, type, url, source, 'discovered' AS status, title FROM f""")
def _(spark, root):
    """All sources at once; a page that several of them name belongs to the one asked first."""
    pages, payloads = _pages(spark, root), _json_pages(spark, root)
    none = spark.createDataFrame([], "id string, type string, url string, source string, status string, title string")
    return discovery.discover(pages, pages, payloads, none, payloads)


@query("fetch_outcomes", """WITH store AS (SELECT url AS address, max(l.etag) AS etag FROM manifest m JOIN process_log l ON l.id = m.id WHERE l.outcome = 'done' GROUP BY url)
  SELECT m.id, CASE WHEN s.address IS NULL THEN 'failed' WHEN coalesce(regexp_replace(m.etag, '^W/', '') = regexp_replace(s.etag, '^W/', ''), false) THEN 'not modified' ELSE 'fetched' END AS outcome
  FROM manifest m LEFT JOIN store s ON s.address = m.url""")
def _(spark, root):
    m = read(spark, root, "manifest").select("id", "type", "url", "etag")
    done = read(spark, root, "process_log").where("outcome = 'done'").select("id", F.col("etag").alias("new"))
    store = m.join(done, "id").groupBy(F.col("url").alias("address")).agg(F.max("new").alias("etag")).withColumn("payload", F.col("address"))
    return raw.fetch(m, store).select("id", "outcome")


@query("fetch_counters", """WITH store AS (SELECT DISTINCT url AS address FROM manifest m JOIN process_log l ON l.id = m.id WHERE l.outcome = 'done')
  SELECT CASE WHEN s.address IS NULL THEN 'failed' ELSE 'fetched' END AS outcome, count(*) AS n FROM manifest m LEFT JOIN store s ON s.address = m.url GROUP BY 1""")
def _(spark, root):
    m = read(spark, root, "manifest").select("id", "type", "url", F.lit(None).cast("string").alias("etag"))
    done = read(spark, root, "process_log").where("outcome = 'done'").select("id").distinct()
    store = m.join(done, "id", "left_semi").select(F.col("url").alias("address"), F.lit("p").alias("payload"), F.lit("e").alias("etag"))
    return raw.counters(raw.fetch(m, store))
