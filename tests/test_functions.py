import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliodor.functions import archives, chunking, docjson, text
from heliodor.operators import graph


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("html", "plain"),
    [
        ("<script>x</script>a", "a"), ("<style>\nb{}\n</style>a", "a"), ("<h1>T</h1><h2>U</h2><h3>V</h3>", "# T\n## U\n### V"), ("<p>a</p><p>b</p>", "a\n\nb"), ("<li>x</li><li>y</li>", "- x\n- y"),
        ("a<BR/>b", "a\nb"), ("&amp;lt;b&gt;", "<b>"), ("<p>a\nb</p>c", "a\nbc"), ("", None), (None, None), ("<p></p>", None), ("a\n \n \n\nb", "a\n\nb"), ("<PRE>x</PRE>", "x"), ("  x  ", "x"),
    ],
)
def test_html(spark, html, plain):
    assert one(spark, text.html_to_text(F.col("h")), h=html) == plain


@pytest.mark.parametrize(("path", "title"), [("/a/foo-bar", "Foo Bar"), ("/a/fooBar-baz", "FooBar Baz"), ("/a/b/", "B"), ("/a/font(_:)", "Font(_:)"), ("x", "X")])
def test_title_from_path(spark, path, title):
    assert one(spark, text.title_from_path(F.col("p")), p=path) == title
    assert docjson.path_title(path) == title


def test_small_functions(spark):
    assert one(spark, text.first_line(F.col("t")), t="## A title \nrest") == "A title"
    assert one(spark, text.first_line(F.col("t")), t="\nrest") is None
    assert one(spark, text.archive_title(F.col("t")), t="MySample.zip") == "My Sample"
    assert one(spark, text.url_id(F.col("u")), u="https://example.com") == "100680ad546ce6a5"
    assert one(spark, text.language_of(F.col("p")), p="a/b.MM") == "objc"
    assert one(spark, text.extension(F.col("p")), p="a/.gitignore") == ""
    assert one(spark, text.split_code_url(F.col("u")), u="http://x/a.zip#b/c#d") == "b/c#d"
    assert one(spark, text.truncate_source(F.col("t"), 3), t="abcd") == "abc\n// ... (truncated)"
    crumbs = one(spark, text.breadcrumbs(F.col("u")), u="http://x/documentation/a/b/c")
    assert [(c["name"], c["path"]) for c in crumbs] == [("a", "/documentation/a"), ("b", "/documentation/a/b")]
    assert one(spark, text.breadcrumbs(F.col("u")), u="http://x/documentation/a") == []
    assert one(spark, text.format_transcript(F.col("t")), t="x0:01Hello0:05again 1:00") == "0:01 Hello\n\n0:05 again 1:00"
    for n, shown in ((0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1536, "1.5 KB"), (5 * 1024**4, "5.0 TB")):
        assert spark.range(1).select(text.format_bytes(F.lit(n).cast("bigint"))).first()[0] == shown


@pytest.mark.parametrize(("path", "kept"), [("a/b.swift", True), ("b.M", True), ("b.png", False), (".h.swift", False), ("x/.build/a.c", False), ("x/Pods/a.c", False), ("Pods/a.c", True), ("README.md", False)])
def test_source_files(spark, path, kept):
    assert one(spark, text.is_source_file(F.col("p")), p=path) is kept


@pytest.mark.parametrize(("n", "total", "waited", "told"), [(1, 500, 0, True), (100, 500, 0, True), (37, 500, 10_000, True), (500, 500, 0, True), (37, 500, 4_000, False), (0, 0, 0, False)])
def test_progress(spark, n, total, waited, told):
    assert spark.range(1).select(text.logs_progress(F.lit(n), F.lit(total), F.lit(waited), F.lit(0))).first()[0] is told


def test_chunk_edges():
    assert chunking.chunks("") == [""]
    assert chunking.chunks(" " + "a" * 9_999) == [" " + "a" * 9_999]
    assert chunking.chunks("a" * 10_001) == ["a" * 10_000, "a"]
    assert chunking.chunks("a" * 6_000 + "\n\n" + "b" * 6_000) == ["a" * 6_000, "b" * 6_000]
    assert chunking.break_point("a" * 9 + ". " + "b" * 20, 20) == 20
    assert chunking.break_point("a" * 12 + ". " + "b" * 20, 20) == 14
    assert chunking.break_point("a" * 20 + " b", 20) == 21
    assert [len(c) for c in chunking.chunks("word " * 3_000)] == [9_999, 4_999]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=200))
def test_chunks_lose_only_space(value):
    cut = chunking.chunks(value, 30)
    assert "".join("".join(cut).split()) == "".join(value.split())
    assert all(len(c) <= 32 for c in cut)


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a" * 10_001, "x"), (2, "b", None), (3, None, None), (2, "b", None)], "k bigint, t string, key string")
    assert sorted((r["key"], r["chunk_index"], len(r["chunk"])) for r in chunking.chunk_table(df.drop("key"), "k", "t").collect()) == [(1, 0, 10_000), (1, 1, 1), (2, 0, 1), (2, 0, 1)]


def test_json_pages():
    page = {
        "title": "T", "abstract": [{"type": "text", "text": "A"}],
        "primaryContentSections": [
            {"kind": "content", "content": [{"type": "heading", "inlineContent": [{"type": "text", "text": "H"}]}, {"type": "orderedList"}, {"type": "codeListing", "syntax": "c", "code": ["x", "y"]},
                                            {"type": "unorderedList", "items": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "emphasis", "inlineContent": [{"type": "text", "text": "e"}]}]}]}]}]},
            {"kind": "declarations", "declarations": [{"tokens": [{"text": "let "}, {"text": "a"}]}]}, {"kind": "parameters", "parameters": [{"name": "p", "content": [{"type": "text", "text": "v"}]}, {}]}, {"kind": "other"}, None],
        "topicSections": [{"title": "More", "identifiers": ["i", 3]}], "seeAlsoSections": [{"identifiers": ["s"]}],
    }
    out = docjson.to_markdown(page, "u")
    assert out == "# T\n\nA\n\n## H\n```c\nx\ny\n```\n- *e*\n\n### Declaration\n\n```\nlet a\n```\n\n### Parameters\n\n- **p**: v\n- **unknown**: \n\n## More\n\n- i\n\n## See Also\n\n- s\n\n---\nSource: u"
    assert docjson.to_markdown(None, "u") == "# Document\n\nNo content available."
    refs = docjson.references({"a": [{"references": [{"url": "/documentation/x-y"}]}], "references": {"k": {"url": "/documentation/z", "title": "Z"}, "n": {"url": "/other"}, "m": 3}}, site="s")
    assert sorted(refs) == [("s/documentation/x-y", "X Y"), ("s/documentation/z", "Z")]
    deep = page = {}
    for _ in range(5_000):
        page["a"] = page = {}
    page["references"] = [{"url": "/documentation/d", "title": "D"}]
    assert len(docjson.references(deep)) == 1


def test_json_columns(spark):
    df = spark.createDataFrame([("u", '{"sampleCodeDownload": {"action": {"isActive": false, "identifier": "x"}}}', None), ("v", "<p>t</p>", None), ("w", None, None)], "url string, payload string, title string")
    assert [r[0] for r in df.select(docjson.json_to_markdown("payload", "url", "title")).collect()][1:] == [None, None]
    assert df.select(docjson.sample_download(F.col("payload"), "b/")).first()[0] is None
    assert graph.edges(df).count() == 0


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("A/b.swift", "x")
        z.writestr("A/c.txt", "y")
        z.writestr("A/d/", "")
    df = spark.createDataFrame([("u", bytearray(out.getvalue())), ("bad", bytearray(b"x")), ("none", None)], "url string, data binary")
    rows = archives.entries(df, "url", "data")
    assert sorted((r["key"], r["path"], r["error"] is None) for r in rows.collect()) == [("bad", None, False), ("none", None, False), ("u", "A/b.swift", True), ("u", "A/c.txt", True)]
    files = archives.source_files(rows.withColumnRenamed("key", "url"), "url")
    assert [r["path"] for r in files.collect()] == ["A/b.swift"]
    md = archives.summary(files.withColumn("t", F.lit("T")), ["url"], "t", "url").first()["markdown"]
    assert md == "# T\n\nURL: u\n\n## Source Files (1)\n\n### A/b.swift\n\n```swift\nx\n```\n\n"


def test_active_downloads(spark):
    from heliodor.functions.docjson import sample_download

    def page(active, identifier='"a/S.zip"'):
        return '{"sampleCodeDownload": {"action": {"isActive": %s, "identifier": %s}}}' % (active, identifier)

    good = [page(a) for a in ("true", "1", '"yes"', "-0.5", "{}", "[]", '"false"')]
    bad = [page(a) for a in ("false", "0", '""', "null", "0.0")] + [page("true", i) for i in ("7", "null", "[]", "true")] + ['{"sampleCodeDownload": null}', "{}", "no json", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "n int, p string")
    got = [r["u"] for r in rows.select("n", sample_download(F.col("p"), "http://b/").alias("u")).orderBy("n").collect()]
    assert got == ["http://b/a/S.zip"] * len(good) + [None] * len(bad)
    full = spark.createDataFrame([(page("true", '"https://c/S.zip"'),)], "p string")
    assert full.select(sample_download(F.col("p"), "http://b/")).first()[0] == "https://c/S.zip"
