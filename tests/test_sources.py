from pyspark.sql import functions as F

from heliodor.functions.text import SITE, url_id
from heliodor.sources import discovery, raw

PAGES = (
    ("a", '<a href="/documentation/ui/view-stack/">A</a> <a href="/documentation/ui/list">B</a> <a href="/documentation/ui/list">B</a> <a href="/videos/play/conf2024/101/">V</a><title>List view - Docs</title>'),
    ("b", '<a href="/videos/play/conf2023/7/">V</a><a href="/videos/play/conf2023/7/">V</a><a href="/documentation/net/session#overview">S</a><TITLE> Session </TITLE>'),
    ("c", "<p>no links</p>"),
)
JSON_PAGE = """{"metadata": {"title": "View", "abstract": [{"type": "text", "text": "A "}, {"type": "codeVoice", "code": "View"}]}, "primaryContentSections": [{"kind": "content", "content": [
 {"type": "heading", "level": 3, "inlineContent": [{"type": "text", "text": "Overview"}]}, {"type": "paragraph", "inlineContent": [{"type": "strong", "inlineContent": [{"type": "text", "text": "Use"}]}, {"type": "reference", "identifier": "doc://app/documentation/ui/list"}]}]}],
 "references": {"a": {"url": "/documentation/ui/list-view"}, "b": {"url": "/documentation/ui/text", "title": "Text", "references": [{"url": "/documentation/ui/deep"}]}, "c": {"url": "/other"}},
 "sampleCodeDownload": {"action": {"isActive": true, "identifier": "abc/Sample.zip"}}}"""


def test_discovery(spark):
    pages = spark.createDataFrame(PAGES, "page string, html string")
    talks = discovery.session_index(pages)
    assert sorted(r["title"] for r in talks.collect()) == ["WWDC2023 Session 7", "WWDC2024 Session 101"]
    assert sorted((r["url"], r["title"]) for r in discovery.hub(pages).collect())[0] == (f"{SITE}/documentation/net/session#overview", "Session#Overview")
    payloads = spark.createDataFrame([(JSON_PAGE,), ("broken",), (None,)], "payload string")
    none = spark.createDataFrame([], "id string, type string, url string, source string, status string, title string")
    everything = discovery.discover(pages, pages, payloads, none, payloads)
    rows = {r["url"]: r["source"] for r in everything.collect()}
    assert rows[f"{SITE}/documentation/ui/list"] == "whats-new" and rows[f"{SITE}/documentation/ui/deep"] == "technologies"
    assert everything.where(F.col("id") != url_id(F.col("url"))).count() == 0
    assert discovery.hub(pages.where(F.lit(False))).count() == 0


def test_fetch(spark):
    todo = spark.createDataFrame([("1", "doc", f"{SITE}/documentation/a", '"x"'), ("2", "doc", f"{SITE}/documentation/b/", None), ("3", "talk", "http://t", 'W/"y"'), ("4", "talk", "http://gone", None)], "id string, type string, url string, etag string")
    store = spark.createDataFrame([(f"{SITE}/documentation/a/data.json", "A", '"x2"'), (f"{SITE}/tutorials/data/documentation/b.json", "B1", None), (f"{SITE}/documentation/b/data.json", "B2", None), ("http://t", "T", '"y"')], "address string, payload string, etag string")
    got = {r["id"]: (r["outcome"], r["payload"]) for r in raw.fetch(todo, store).collect()}
    assert got == {"1": ("fetched", "A"), "2": ("fetched", "B1"), "3": ("not modified", None), "4": ("failed", None)}
    assert {r["outcome"]: r["n"] for r in raw.counters(raw.fetch(todo, store)).collect()} == {"fetched": 2, "not modified": 1, "failed": 1}


def test_stored_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("1", "doc", "a"), ("2", "talk", "b")], "id string, type string, payload string")
    raw.write_by_type(rows, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw")).where("type = 'doc'")
    assert [r["payload"] for r in back.collect()] == ["a"]
    old = spark.createDataFrame([("1", "old"), ("3", "c")], "id string, payload string")
    assert sorted((r["id"], r["payload"]) for r in raw.existing(rows, old).collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_folders_of_files(spark, tmp_path):
    import io
    import zipfile

    from heliodor.functions import archives

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("A/b.swift", "let b")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "x1.md").write_text("# One\n\ntext\n")
    (tmp_path / "x2.txt").write_text("two")
    (tmp_path / "skip.json").write_text("{}")
    zips = raw.archive_files(spark, str(tmp_path))
    assert [(r["path"], r["content"]) for r in archives.entries(zips, "path", "payload").collect()] == [("A/b.swift", "let b")]
    assert sorted(tuple(r) for r in raw.normalized_files(spark, str(tmp_path)).collect()) == [("x1", "# One\n\ntext\n"), ("x2", "two")]
