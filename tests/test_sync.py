import io
import zipfile

from pyspark.sql import functions as F

from heliodor.functions import text
from heliodor.operators import embedding, incremental, search
from heliodor.plans import sync

RAW = "id string, type string, url string, source string, title string, payload string, etag string, content_hash string"


def read(spark, tmp_path, name):
    return incremental.Target(spark, f"file://{tmp_path}/s/{name}").read()


def test_changed_record_is_embedded_again(spark, tmp_path):
    root, long = f"file://{tmp_path}/s", "word " * 3_000
    rows = [("1", "code_file", "u1", "x", "T", long, "e", "h"), ("2", "code_file", "u2", "x", "T", "stays", "e", "h")]
    assert sync.sync(spark, root, spark.createDataFrame(rows, RAW))["embed"] == 3
    kept = {r["id"]: r["embedding"] for r in read(spark, tmp_path, "vectors").collect()}["2"]
    rows[0] = ("1", "code_file", "u1", "x", "T", "quite another text", "e2", "h2")
    changed = spark.createDataFrame(rows, RAW)
    assert sync.sync(spark, root, changed)["embed"] == 1
    got = {(r["id"], r["etag"]): r["embedding"] for r in read(spark, tmp_path, "vectors").collect()}
    want = embedding.hashing_embedder(["T\n\nquite another text"])[0].tolist()
    assert got == {("1", "e2"): want, ("2", "e"): kept}  # neither the old text's vector nor that of its second chunk is left
    assert read(spark, tmp_path, "vectors").join(read(spark, tmp_path, "content"), "content_rowid").count() == 2
    assert set(sync.sync(spark, root, changed).values()) == {0}


def test_vectors_without_versions_are_replaced(spark, tmp_path):
    raw = spark.createDataFrame([("1", "code_file", "u1", "x", "T", "text", "e", "h")], RAW)
    root = f"file://{tmp_path}/s"
    sync.sync(spark, root, raw, {"discover": True}), sync.sync(spark, root, raw, {"normalize": True})
    incremental.Target(spark, f"{root}/vectors").publish(spark.range(1).select(F.col("id").alias("content_rowid"), F.array(F.lit(0.0).cast("float")).alias("embedding"), F.lit("0").alias("id")))
    sync.sync(spark, root, raw, {"index": True})
    assert [r["id"] for r in read(spark, tmp_path, "vectors").collect()] == ["1"]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, body in files.items():
            z.writestr(path, body)
    return bytearray(out.getvalue())


def test_archives_become_code_files(spark, tmp_path):
    root, schema = f"file://{tmp_path}/s", RAW.replace("payload string", "payload binary")
    rows = [("1", "sample", "u/a.zip", "x", "A", archive({"A/b.swift": "let b", "A/c.m": "c", "A/logo.png": b"\x89", "A/.h.swift": "x"}), "e", "h"), ("2", "sample", "u/none.zip", "x", None, archive({"r.txt": ""}), "e", "h"), ("3", "sample", "u/bad.zip", "x", "B", bytearray(b"no zip"), "e", "h")]
    first = sync.sync(spark, root, spark.createDataFrame(rows, schema))
    assert first == {"discover": 3, "normalize": 5, "index": 4, "embed": 4}
    texts = {r["url"]: (r["title"], r["text"], r["error"] is None) for r in read(spark, tmp_path, "texts").collect()}
    summary = "# A\n\nURL: u/a.zip\n\n## Source Files (2)\n\n### A/b.swift\n\n```swift\nlet b\n```\n\n### A/c.m\n\n```objc\nc\n```\n\n"
    assert texts == {"u/a.zip": ("A", summary, True), "u/none.zip": (None, "# Sample Code\n\nURL: u/none.zip\n\n## Source Files (0)\n\n", True), "u/bad.zip": ("B", None, False), "u/a.zip#A/b.swift": ("A - b.swift", "let b", True), "u/a.zip#A/c.m": ("A - c.m", "c", True)}
    code = read(spark, tmp_path, "manifest").where("type = 'code_file'").select("id", "url", "source", "status")
    assert sorted(code.drop("id").collect()) == [("u/a.zip#A/b.swift", "sample-extract", "normalized"), ("u/a.zip#A/c.m", "sample-extract", "normalized")]
    assert code.where(F.col("id") != text.url_id(F.col("url"))).count() == 0
    # a new archive: one file as it was, one gone, one new
    rows[0] = (*rows[0][:5], archive({"A/b.swift": "let b", "A/d.c": "d"}), "e2", "h2")
    second = sync.sync(spark, root, spark.createDataFrame(rows, schema))
    assert (second["index"], second["embed"]) == (2, 2)
    for name in ("manifest", "texts", "content"):
        assert sorted(r["url"] for r in read(spark, tmp_path, name).where("type = 'code_file'").collect()) == ["u/a.zip#A/b.swift", "u/a.zip#A/d.c"], name
    assert read(spark, tmp_path, "vectors").count() == read(spark, tmp_path, "content").count() == 4


def test_transcripts_of_old_pages(spark):
    pages = {
        "json": """<script>{"transcript": [{"text": "one"}, {"at": 1}, "x", {"text": "two"}]}</script><p>page</p>""",
        "div": """<div id="a" class="x transcript-y"><p>said</p></div><p>page</p>""",
        "broken": """<html>{"transcript": [{'text': 'one'}]}<div class="transcript">said</div>""",
        "page": "<p>page</p>",
        "empty": "",
    }
    rows = spark.createDataFrame([(k, "talk", "u", "T", v) for k, v in pages.items()], "id string, type string, url string, title string, payload string")
    head = "# T\n\nURL: u\n\n"
    assert {r["id"]: r["text"].removeprefix(head) for r in sync.normalize(rows).collect()} == {"json": "## Transcript\n\none two\n", "div": "## Transcript\n\nsaid\n", "broken": "## Transcript\n\nsaid\n", "page": "## Content\n\npage\n", "empty": ""}


def test_fetching_from_a_store(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    records = spark.createDataFrame([("d", "doc", f"{text.SITE}/documentation/ui/view", "wwdc", "View"), ("t", "talk", "u/talk", "wwdc", "Talk"), ("m", "doc", "u/missing", "wwdc", "Gone")], "id string, type string, url string, source string, title string")
    page = b'{"title": "View", "abstract": [{"type": "text", "text": "Words."}], "sampleCodeDownload": {"action": {"isActive": 1, "identifier": "x/MySample.zip"}}}'
    store = [(f"{text.SITE}/tutorials/data/documentation/ui/view.json", bytearray(page), "1"), ("u/talk", bytearray(b'{"title": "K", "transcript": "hello"}'), "1"), (f"{sync.DOWNLOADS}x/MySample.zip", archive({"A/b.swift": "let b"}), "1")]
    f = "address string, payload binary, etag string"
    first = sync.sync(spark, root, records, store=spark.createDataFrame(store, f), now_ms=1)
    assert first == {"discover": 3, "fetch": 3, "normalize": 4, "index": 4, "embed": 4}
    held = {r["url"]: (r["source"], r["status"], r["title"]) for r in read(spark, tmp_path, "manifest").collect()}
    assert held[f"{sync.DOWNLOADS}x/MySample.zip"] == ("sample-download", "fetched", "My Sample") and held["u/missing"][1] == "failed"
    # the failed one comes again, and is found now; nothing else is fetched
    store.append(("u/missing", bytearray(b"<p>here</p>"), "1"))
    second = sync.sync(spark, root, records, store=spark.createDataFrame(store, f), now_ms=2)
    assert second == {"discover": 0, "fetch": 1, "normalize": 1, "index": 1, "embed": 1}
    # all again: validators hold, so no payload travels; then one has changed
    assert sync.sync(spark, root, records, store=spark.createDataFrame(store, f), refresh_all=True, now_ms=3)["fetch"] == 0
    store[1] = ("u/talk", bytearray(b'{"title": "K", "transcript": "hello again"}'), "2")
    third = sync.sync(spark, root, records, store=spark.createDataFrame(store, f), refresh_all=True, now_ms=4)
    assert (third["fetch"], third["normalize"], third["embed"]) == (1, 1, 1)


def test_failed_records_are_taken_again(spark, tmp_path):
    root, empty_then_full = f"file://{tmp_path}/s", [("1", "doc", "u1", "x", "T", None, "e", "h")]
    sync.sync(spark, root, spark.createDataFrame(empty_then_full, RAW))
    empty_then_full[0] = ("1", "doc", "u1", "x", "T", "<p>now</p>", "e", "h")
    again = sync.sync(spark, root, spark.createDataFrame(empty_then_full, RAW))
    assert (again["normalize"], again["index"], again["embed"]) == (1, 1, 1)


def test_the_index_follows_the_content(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    rows = [("1", "code_file", "u1", "x", "T", "smooth toolbars", "e", "h"), ("2", "code_file", "u2", "x", "T", "other toolbars", "e", "h")]
    for change in (None, ("1", "code_file", "u1", "x", "T", "quite another text", "e2", "h2")):
        if change:
            rows[0] = change
        sync.sync(spark, root, spark.createDataFrame(rows, RAW))
        stored, content = sync.open_index(spark, root), sync.open_table(spark, root, "content")
        for words in ("toolbars", '"smooth toolbars"', "text"):
            want = sorted(map(tuple, search.keyword_search(content, words).collect()))
            assert sorted(map(tuple, search.keyword_search(content, words, index=stored.occurrences, sizes=stored.lengths).collect())) == want
    assert sync.open_table(spark, root, "content_vec").count() == sync.open_table(spark, root, "content_vec_map").count() == 2
