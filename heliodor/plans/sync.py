"""The batch pipeline from raw payloads to an index, one declarative job a stage, resumable between stages.

Tables live under a root: manifest, raw (fetched payloads), texts, content, index and lengths (the inverted index), vectors. Each is a versioned target, so a run that
fails leaves the last published state, and the next run takes what is still pending. A record that failed is pending again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.functions import archives, chunking, docjson, text
from heliodor.operators import embedding, manifest, search
from heliodor.operators.incremental import Target, pending
from heliodor.session import materialise
from heliodor.sources import raw as payloads
from heliodor.sources.tables import read

STAGES = ("discover", "fetch", "normalize", "index", "embed")
#: Fixed value: where relative sample downloads lie.
DOWNLOADS = f"{text.SITE}/assets/"


def gates(only: dict[str, bool]) -> tuple[str, ...]:
    """The stages to run: all, or the one asked for. Asking for two at once is refused."""
    asked = [s for s in STAGES if only.get(s)]
    if len(asked) > 1:
        raise ValueError(f"choose one of {', '.join(asked)}")
    return ("index", "embed") if asked == ["index"] else tuple(asked) or STAGES


def is_archive() -> Column:
    return F.coalesce((F.col("type") == "sample") & F.col("url").endswith(".zip"), F.lit(False))


def unpack(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text, error) of the archives among `rows`, and (id, archive, url, title, text) of the source files in them.

    An archive's text is its summary; a broken one has an error and no files. A file that can't be read is left out.
    """
    zips = rows.where(is_archive()).select(F.col("id").alias("key"), "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("Sample Code")).alias("sample"), F.col("payload").cast("binary").alias("payload"))
    found = materialise(archives.entries(zips, "key", "payload", text.SOURCE_EXTENSIONS), "entries")
    named = zips.drop("payload")
    files = archives.source_files(found.join(named, "key"), "url")
    broken = found.where("path IS NULL").select("key", "error")
    none = F.concat(F.lit("# "), "sample", F.lit("\n\nURL: "), "url", F.lit("\n\n## Source Files (0)\n\n"))
    whole = named.join(archives.summary(files, ["key"], "sample", "url"), "key", "left").join(broken, "key", "left")
    texts = whole.select(F.col("key").alias("id"), F.when(F.col("error").isNull(), F.coalesce("markdown", none)).alias("text"), "error")
    title = F.concat("sample", F.lit(" - "), F.element_at(F.split("path", "/"), -1))
    return texts, files.select("id", F.col("key").alias("archive"), F.col("code_url").alias("url"), title.alias("title"), F.col("content").alias("text"))


def normalize(rows: DataFrame) -> DataFrame:
    """(id, text, error) of rows (id, type, url, title, payload): JSON pages, talks in JSON, and HTML as the way out.

    Archives are left to `unpack`. A row that gives no text has an error in the place of an exception.
    """
    payload = F.col("payload").cast("string")
    talk = F.from_json(payload, "title string, transcript string, description string, resources array<string>")
    as_talk = F.when(F.get_json_object(payload, "$").isNotNull() & payload.startswith("{"), text.talk_markdown(F.coalesce(F.nullif(talk["title"], F.lit("")), F.col("title")), F.col("url"), talk["description"], talk["transcript"], talk["resources"]))
    section = F.coalesce(F.concat(F.lit("## Transcript\n\n"), text.page_transcript(payload), F.lit("\n")), F.concat(F.lit("## Content\n\n"), text.html_to_text(payload), F.lit("\n")), F.lit(""))
    as_page = F.when(payload.isNotNull(), F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Session")), F.lit("\n\nURL: "), "url", F.lit("\n\n"), section))
    talks = rows.where("type = 'talk'").select("id", F.coalesce(as_talk, as_page).alias("text"))
    docs = rows.where("type = 'doc'").select("id", F.coalesce(docjson.json_to_markdown(payload, "url", "title"), text.html_to_text(payload)).alias("text"))
    samples = rows.where("type = 'sample'").where(~is_archive()).select("id", F.concat(F.lit("# "), F.coalesce("title", F.lit("Sample Code")), F.lit("\n\nURL: "), "url", F.lit("\n\n"), F.coalesce(text.html_to_text(payload), F.lit(""))).alias("text"))
    code = rows.where("type = 'code_file'").select("id", payload.alias("text"))
    out = docs.unionAll(talks).unionAll(samples).unionAll(code)
    return out.withColumn("error", F.when(F.col("text").isNull(), "no text"))


def index(rows: DataFrame) -> DataFrame:
    """Content rows of (id, type, url, title, text): chunks with their row ids made from id and position."""
    cut = chunking.chunk_table(rows, "id", "text").withColumnRenamed("key", "id")
    named = rows.select("id", "type", "url", F.coalesce("title", text.first_line(F.col("text")), F.lit("Untitled")).alias("title"))
    body = cut.join(named, "id").withColumnRenamed("chunk", "body")
    rowid = F.shiftrightunsigned(F.xxhash64("id", "chunk_index"), 1)
    return body.select(rowid.alias("content_rowid"), "id", "chunk_index", "title", "body", "type", F.lit(None).cast("string").alias("platforms"), "url", F.concat_ws("/", F.lit("normalized"), "id").alias("local_path"))


def _stored(rows: DataFrame) -> DataFrame:
    """Manifest rows with the columns of the fetch stage, null where a publication had none."""
    kinds = {"etag": "string", "content_hash": "string", "fetched_at": "bigint"}
    return rows.select(*rows.columns, *(F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in rows.columns))


def fetch(spark: SparkSession, root: str, store: DataFrame, refresh_all: bool = False, now_ms: int = 0) -> int:
    """Look up the payloads of discovered and failed records in `store` (address, payload, etag); the number that were fetched.

    Records fetched more than a year before `now_ms`, or with `refresh_all` all records, are discovered again first; of an unchanged one
    the payload stays. A sample that a fetched page offers for download becomes a record of its own and is fetched in the same run.
    """
    listed, kept, fetched = Target(spark, f"{root}/manifest"), Target(spark, f"{root}/raw"), 0
    for downloads in (False, True):
        rows = listed.read()
        if rows is None:
            return 0
        rows = _stored(rows)
        if not downloads:
            rows = manifest.reset_all(rows) if refresh_all else manifest.refresh(rows, now_ms)
        todo = manifest.fetchable(rows.withColumn("last_modified", F.lit(None).cast("string"))).drop("priority", "last_modified")
        if downloads:
            todo = todo.where("source = 'sample-download' AND status = 'discovered' AND fetched_at IS NULL")
        got = materialise(payloads.fetch(todo.select("id", "type", "url", "etag"), store), "fetched")
        new = todo.drop("etag", "content_hash", "fetched_at", "status").join(got.where("outcome = 'fetched'").select("id", "payload", "etag", "content_hash"), "id")
        fetched += kept.publish(new.withColumn("fetched_at", F.lit(now_ms).cast("bigint")))
        told = todo.drop("etag", "content_hash", "fetched_at", "status").join(got.select("id", "outcome", "etag", F.col("content_hash").alias("new_hash")), "id").join(rows.select("id", F.col("content_hash").alias("old_hash")), "id")
        status = F.when(F.col("outcome") == "failed", "failed").otherwise("fetched")
        told = told.select(*todo.drop("etag", "content_hash", "fetched_at", "status").columns, status.alias("status"), "etag", F.coalesce("new_hash", "old_hash").alias("content_hash"), F.when(F.col("outcome") != "failed", F.lit(now_ms)).cast("bigint").alias("fetched_at"))
        listed.publish(materialise(told, "manifest"))
        if not downloads and kept.current():
            url = docjson.sample_download(F.col("payload").cast("string"), DOWNLOADS)
            found = kept.read().where("type = 'doc'").select(url.alias("url")).where("url IS NOT NULL").distinct()
            zips = found.select(text.url_id(F.col("url")).alias("id"), F.lit("sample").alias("type"), "url", F.lit("sample-download").alias("source"), text.archive_title(F.regexp_extract("url", "([^/]*)$", 1)).alias("title"), F.lit("discovered").alias("status"))
            listed.publish(materialise(_unlisted(listed, zips), "downloads"))
    return fetched


def sync(
    spark: SparkSession, root: str, raw: DataFrame, only: dict[str, bool] | None = None, embedder: embedding.Embedder = embedding.hashing_embedder,
    store: DataFrame | None = None, refresh_all: bool = False, now_ms: int = 0,
) -> dict[str, int]:
    """Run the stages over `raw` (id, type, url, source, title, and, without a `store`, payload, etag, content_hash); rows taken by each.

    With a `store` the payloads come from the fetch stage. Only records whose version isn't in the targets are taken, so running
    twice changes nothing but for another try of what failed.
    """
    stages, taken = gates(only or {}), {}
    listed = Target(spark, f"{root}/manifest")
    if "discover" in stages:
        found = raw.select("id", "type", "url", "source", "title").withColumn("status", F.lit("discovered"))
        taken["discover"] = listed.publish(_unlisted(listed, found))
    if "fetch" in stages and store is not None:
        taken["fetch"] = fetch(spark, root, store, refresh_all, now_ms)
    columns = ["id", "type", "url", "source", "title", "payload", "etag", "content_hash"]
    stored = Target(spark, f"{root}/raw").read() if store is not None else None
    known = raw.select(*columns) if store is None else stored.select(*columns) if stored is not None else None
    texts = Target(spark, f"{root}/texts")
    if "normalize" in stages and known is not None:
        # a record that failed has no valid output, so it is taken again
        old = texts.read()
        todo = known if old is None else pending(known, old.where("error IS NULL"))
        summaries, files = unpack(todo)
        done = normalize(todo).unionAll(summaries).join(todo.select("id", "type", "url", "title", "etag", "content_hash"), "id")
        # a file's version is its content, so only the changed files of a new archive are indexed and embedded again
        files = files.join(known.select("id"), "id", "left_anti").withColumns({"type": F.lit("code_file"), "content_hash": text.content_hash(F.col("text"))})
        gone = None
        if old is not None and "archive" in old.columns:
            gone = old.join(summaries.where("error IS NULL").select(F.col("id").alias("archive")), "archive", "left_semi").select("id").join(files.select("id"), "id", "left_anti")
        code = files.select("id", "type", "url", F.lit("sample-extract").alias("source"), "title", F.lit("normalized").alias("status"))
        listed.publish(_unlisted(listed, code), gone)
        taken["normalize"] = texts.publish(done.unionByName(files, allowMissingColumns=True), gone)
    contents = Target(spark, f"{root}/content")
    if "index" in stages and texts.current():
        ready, state = texts.read().where("error IS NULL"), contents.state()
        todo = ready if state is None else pending(ready, state)
        rows = index(todo).join(todo.select("id", "etag", "content_hash"), "id")
        old = contents.read()
        gone = old.select("id").distinct().join(texts.read().select("id"), "id", "left_anti") if old is not None else None
        taken["index"] = contents.publish(rows, gone)
    if "index" in stages and contents.current():
        _index_terms(spark, root, contents.read())
    vectors = Target(spark, f"{root}/vectors")
    if "embed" in stages and contents.current():
        content, old = contents.read(), vectors.read()
        # by record and version, as a new version's chunks have the row ids of the old one's; vectors of no version are made again
        versioned = old is not None and "etag" in old.columns
        todo = pending(content, vectors.state().distinct()) if versioned else content
        rows = embedding.embed(todo, content.select("content_rowid").where(F.lit(False)), embedder, carry=("id", "etag", "content_hash"))
        gone = old.select("id").distinct().join(content.select("id"), "id", "left_anti") if old is not None else None
        taken["embed"] = vectors.publish(rows, gone)
    return taken


def _index_terms(spark: SparkSession, root: str, content: DataFrame) -> None:
    """Bring the inverted index up to `content`. The lengths are published last and are the state, so a run that dies between is made good."""
    occurrences, lengths = Target(spark, f"{root}/index"), Target(spark, f"{root}/lengths")
    old = lengths.read()
    todo = content if old is None else pending(content, old.select("id", "etag", "content_hash").distinct())
    todo = todo.select("content_rowid", *search.COLUMNS, "id", "etag", "content_hash")
    of = todo.select(F.col("content_rowid").alias("rowid"), "id", "etag", "content_hash")
    gone = old.select("id").distinct().join(content.select("id"), "id", "left_anti") if old is not None else None
    rows = search.occurrences(todo).join(of.select("rowid", "id"), "rowid")
    occurrences.publish(rows.repartitionByRange("term", "rowid").sortWithinPartitions("term", "rowid", "col", "pos"), gone)
    lengths.publish(search.lengths(todo).join(of, "rowid"), gone)


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table that `sync` keeps under `root`, or the Parquet table of that name; the vectors of either in the form of the latter."""
    kept = {"content_vec": "vectors", "content_vec_map": "vectors"}.get(name, name)
    held = Target(spark, f"{root}/{kept}").read()
    if held is None:
        return read(spark, root, name)
    if name == "content_vec":
        return held.select(F.col("content_rowid").alias("vec_rowid"), "embedding")
    if name == "content_vec_map":
        return held.select("content_rowid", F.col("content_rowid").alias("vec_rowid"))
    return held


def open_index(spark: SparkSession, root: str) -> search.Stored:
    """The inverted index that `sync` keeps, or one built from the Parquet table."""
    occurrences, lengths = Target(spark, f"{root}/index").read(), Target(spark, f"{root}/lengths").read()
    return search.index_of(spark, root) if occurrences is None or lengths is None else search.Stored(occurrences.drop("id"), lengths.select("rowid", "dl"))


def _unlisted(target: Target, found: DataFrame) -> DataFrame:
    """The resources of `found` that the manifest doesn't list yet."""
    old = target.read()
    return manifest.insert_ignore(old.select(*found.columns), found).join(old.select("id"), "id", "left_anti") if old is not None else manifest.merge_discoveries(found)
