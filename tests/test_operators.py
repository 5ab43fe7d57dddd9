import sqlite3

import pytest
from pyspark.sql import functions as F

from heliodor.operators import embedding, graph, incremental, manifest, resolve, retention, search, status
from heliodor.plans import sync
from heliodor.sources.tables import FIELDS, empty
from heliodor.streaming.ingest import ingest

SITE = "https://developer.orchardworks.example"


def content(spark, bodies, type_="doc"):
    return spark.createDataFrame([(i, f"id{i}", 0, f"Title {i}", b, type_, None, f"u{i}", "p") for i, b in enumerate(bodies, 1)], FIELDS["content"])


def test_query_compiler():
    assert search.compile_query("swiftui navigation") == [search.Term(("swiftui",), True), search.Term(("navigation",), True)]
    assert search.compile_query('"exact phrase" word') == [search.Term(("exact", "phrase"), False), search.Term(("word",), True)]
    assert search.compile_query('foo"bar"baz') == [search.Term(("bar",), False), search.Term(("foobaz",), True)]
    assert search.compile_query("a + b AND") == [search.Term(("a",), False), search.Term(("b",), False), search.Term(("and",), True)]
    assert search.compile_query("view* -x font(_:)") == [search.Term(("view",), True), search.Term(("x",), False), search.Term(("font",), True)]
    assert search.compile_query("") == [] and search.compile_query("+ -") == []
    with pytest.raises(search.QuerySyntaxError):
        search.compile_query("c++", strict=True)


def test_bm25_equals_fts5(spark):
    bodies = ["the quick brown fox", "the lazy dog and the fox", "réaction of foo_bar", "nothing here", "fox fox fox", "quick fox jumps", "a lazy afternoon", "unrelated words only"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, type, platforms)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, title, body, type, platforms) VALUES (?, ?, ?, 'doc', NULL)", [(i, f"Title {i}", b) for i, b in enumerate(bodies, 1)])
    rows = content(spark, bodies)
    for words, match in (("fox", "fox*"), ("laz quick", "laz* OR quick*"), ('"lazy dog"', '"lazy dog"'), ("reaction", "reaction*"), ("title", "title*"), ("bar", "bar*")):
        want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        got = {r["rowid"]: r["score"] for r in search.bm25(rows, search.compile_query(words)).collect()}
        assert got.keys() == want.keys(), words
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), words


def test_search_edges(spark):
    none = empty(spark, "content")
    assert search.keyword_search(none, "x y").count() == 0
    assert search.keyword_search(content(spark, ["a"]), "").count() == 0
    rows = spark.createDataFrame([(1, "i", 0, None, None, "doc", None, "u", "p"), (2, "i", 1, "same", "same", None, None, "u", "p"), (3, "i", 2, "same", "same", None, None, "u", "p")], FIELDS["content"])
    got = search.keyword_search(rows, "same").orderBy("fts_rank").collect()
    assert [r["rowid"] for r in got] == [2, 3]


def test_stored_index_gives_the_same(spark, tmp_path):
    rows = content(spark, ["smooth toolbars here", "toolbars smooth", "smooth smooth toolbars", "none"])
    search.occurrences(rows).write.parquet(str(tmp_path / "index"))
    search.lengths(rows).write.parquet(str(tmp_path / "sizes"))
    index, sizes = spark.read.parquet(str(tmp_path / "index")), spark.read.parquet(str(tmp_path / "sizes"))
    for words in ('"smooth toolbars"', "smo tool"):
        want = search.keyword_search(rows, words).collect()
        assert sorted(map(tuple, want)) == sorted(map(tuple, search.keyword_search(rows, words, index=index, sizes=sizes).collect())) and want


def test_phrase_stays_in_one_column(spark):
    rows = spark.createDataFrame([(1, "i", 0, "main", "thread", "doc", None, "u", "p"), (2, "i", 1, "x", "main thread main thread", "doc", None, "u", "p")], FIELDS["content"])
    assert [r["rowid"] for r in search.bm25(rows, search.compile_query('"main thread"')).collect()] == [2]


def test_vectors_and_fusion(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], FIELDS["content_vec"])
    assert [r["vec_rowid"] for r in search.knn(vectors, [1.0, 0.0], 3).collect()] == [1, 3, 2]
    mapping = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (99, 3)], FIELDS["content_vec_map"])
    rows = content(spark, ["alpha words", "beta words", "gamma"])
    semantic = search.semantic_search(rows, vectors, mapping, [1.0, 0.0])
    assert [(r["rowid"], r["vec_rank"]) for r in semantic.orderBy("vec_rank").collect()] == [(1, 1), (2, 2)]
    fused = search.fuse(search.keyword_search(rows, "beta"), semantic).collect()
    assert fused[0]["rowid"] == 2 and abs(fused[0]["score"] - (1 / 61 + 1 / 62)) < 1e-12
    hits = search.hybrid_search(rows, vectors, mapping, "beta", [1.0, 0.0]).collect()
    assert {r["rowid"]: r["snippet"] for r in hits} == {2: "beta words", 1: "alpha words..."}
    assert search.hybrid_search(rows, vectors, mapping, "beta", [1.0, 0.0], keyword_only=True, semantic_only=True).count() == 0
    assert search.semantic_search(rows, vectors, mapping, [1.0, 0.0], type_="talk").count() == 0
    assert search.knn(empty(spark, "content_vec"), [1.0], 3).count() == 0


def test_snippet():
    words = [f"w{i}" for i in range(100)]
    body = " ".join(words)
    cut = search.snippet(body, [search.Term(("w50",), False)])
    assert cut.startswith("...w35 ") and cut.endswith(" w66...")
    assert search.snippet(body, [search.Term(("zzz",), False)]) == " ".join(words[:32]) + "..."
    assert search.snippet("short text", [search.Term(("text",), False)]) == "short text"
    assert search.snippet("", []) == ""


def test_manifest(spark):
    f = "id string, url string, status string, etag string, fetched_at bigint"
    old = spark.createDataFrame([("1", "u1", "fetched", "e", 5), ("2", "u2", "failed", "e", None)], f)
    new = spark.createDataFrame([("1", "u9", "discovered", None, None), ("9", "u1", "discovered", None, None), ("3", "u3", "discovered", None, None), ("4", "u3", "discovered", None, None), (None, "u5", None, None, None)], f)
    assert sorted(r["id"] for r in manifest.insert_ignore(old, new).collect()) == ["1", "2", "3"]
    assert sorted((r["id"], r["url"]) for r in manifest.upsert(old, new.where("id IN ('1', '3')"), "id").collect()) == [("1", "u9"), ("2", "u2"), ("3", "u3")]
    assert [r["etag"] for r in manifest.patch(old, spark.createDataFrame([("1", "n")], "id string, etag string"), "id", ["etag"]).orderBy("id").collect()] == ["n", "e"]
    assert [r["status"] for r in manifest.refresh(old, 10, 5).orderBy("id").collect()] == ["fetched", "failed"]
    assert [r["status"] for r in manifest.refresh(old, 11, 5).orderBy("id").collect()] == ["discovered", "failed"]
    assert [r["etag"] for r in manifest.fetchable(old.withColumn("source", F.lit("x")).withColumn("last_modified", F.lit("m"))).collect()] == [None]
    bad = old.withColumn("type", F.lit("bogus")).unionByName(old.withColumn("type", F.lit("doc")))
    assert {r["rule"] for r in manifest.violations(bad).collect()} == {"duplicate id", "duplicate url", "bad type"}


def test_delete_with_vectors(spark):
    rows = content(spark, ["a", "b"])
    ids = spark.createDataFrame([("id1",)], "id string")
    mapping = spark.createDataFrame([(1, 10), (2, 20)], FIELDS["content_vec_map"])
    vectors = spark.createDataFrame([(10, [0.0] * 384), (20, [0.0] * 384)], FIELDS["content_vec"])
    a, b, c = manifest.delete_with_vectors(ids, rows, mapping, vectors)
    assert [x.count() for x in (a, b, c)] == [1, 1, 1]
    assert [r["vec_rowid"] for r in embedding.orphans(a, mapping, vectors).collect()] == [10]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "c"), ("x", "y")], "src_url string, dst_url string")
    start = spark.createDataFrame([("a",)], "url string")
    assert sorted((r["url"], r["hops"]) for r in graph.closure(e, start).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    m = spark.createDataFrame([("1", "doc", "a"), ("2", "doc", "b"), ("3", "talk", "c")], "id string, type string, url string")
    p = spark.createDataFrame([("a", "processed"), ("a", "processed"), ("b", "failed")], "url string, status string")
    assert [r["url"] for r in graph.frontier(m, p).collect()] == ["b"]
    assert graph.processed_count(m, p).first()[0] == 1


def test_resolver(spark):
    m = spark.createDataFrame([("18a1df7aeac96f2c", f"{SITE}/documentation/ui/view"), ("041d85c4df24ee54", f"{SITE}/documentation/UI/Mode")], "id string, url string")
    refs = ["18a1df7aeac96f2c", "doc://app/documentation/ui/view", "/documentation/ui/view", f"{SITE}/documentation/ui/mode", "0000000000000000", "what"]
    got = {r["ref"]: r["id"] for r in resolve.resolve(spark.createDataFrame([(r,) for r in refs], "ref string"), m).collect()}
    assert [got[r] for r in refs] == ["18a1df7aeac96f2c"] * 3 + ["041d85c4df24ee54", None, None]


def test_status_and_prune(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert status.counts_map(rows, "s").first()[0] == '{"a":2}'
    (tmp_path / "x").write_bytes(b"1" * 12)
    (tmp_path / "y").write_bytes(b"2" * 30)
    assert retention.usage(retention.listing(spark, str(tmp_path))).first().asDict() == {"files": 2, "bytes": 42}
    assert retention.prune(spark, str(tmp_path), dry_run=True) == {"files": 2, "bytes": 42} and (tmp_path / "x").exists()
    assert retention.prune(spark, str(tmp_path))["files"] == 2 and not (tmp_path / "x").exists()


def log(spark, rows):
    return spark.createDataFrame(rows, "log_id bigint, run_id int, id string, etag string, content_hash string, outcome string, logged_at int")


def test_pending_versions(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "rolled_back"), (3, "failed")], "run_id int, outcome string")
    rows = [(1, 1, "same", '"a"', "h", "done", 1), (1, 1, "same", '"a"', "h", "done", 1), (2, 1, "weak", 'W/"a"', "x", "done", 1), (3, 1, "hash", None, "h", "done", 1), (4, 1, "new", '"a"', "h", "done", 1), (5, 2, "undone", '"b"', "h", "done", 2), (6, 1, "undone", '"a"', "h", "done", 1),
            (7, 3, "failedrun", '"b"', "h", "done", 2), (8, 1, "skipped", '"b"', "h", "skipped", 3), (9, 1, "order", '"b"', "h", "done", 5), (10, 1, "order", '"a"', "h", "done", 4), (11, 1, None, '"b"', "h", "done", 9), (12, 1, "nulls", None, None, "done", 1)]
    state = incremental.target_state(log(spark, rows), runs)
    ids = ["same", "weak", "hash", "new", "undone", "failedrun", "skipped", "order", "never", "nulls", None]
    source = spark.createDataFrame([(i, None if i == "nulls" else '"b"' if i not in ("same", "weak") else '"a"', None if i == "nulls" else "h", "x") for i in ids], "id string, etag string, content_hash string, __key2 string")
    assert sorted(r["id"] for r in incremental.pending(source, state).collect()) == ["never", "new", "nulls", "skipped", "undone"]
    nothing = state.where(F.lit(False))
    assert incremental.pending(source, nothing).count() == len(ids) - 1
    assert incremental.pending(source.where(F.lit(False)), state).count() == 0


def test_target_publishes_atomically(spark, tmp_path):
    target = incremental.Target(spark, f"file://{tmp_path}/t")
    assert target.read() is None
    f = "id string, etag string, content_hash string, text string"
    target.publish(spark.createDataFrame([("1", "a", "h", "x"), ("2", "a", "h", "y")], f))
    first = target.current()
    target.publish(spark.createDataFrame([("2", "b", "h", "z")], f))
    assert sorted((r["id"], r["text"]) for r in target.read().collect()) == [("1", "x"), ("2", "z")] and target.current() != first
    # a run that dies after staging leaves the published version
    spark.createDataFrame([("3", "a", "h", "q")], f).write.parquet(f"file://{tmp_path}/t/p-dead/rows")
    assert target.read().count() == 2
    source = spark.createDataFrame([("1", "a", "h"), ("2", "c", "h"), ("3", "a", "h")], "id string, etag string, content_hash string")
    assert sorted(r["id"] for r in incremental.pending(source, target.state()).collect()) == ["2", "3"]


RAW = "id string, type string, url string, source string, title string, payload string, etag string, content_hash string"


def test_sync_is_idempotent(spark, tmp_path):
    raw = spark.createDataFrame([("1", "doc", "u1", "wwdc", "T", '{"title": "P"}', "e", "h"), ("2", "talk", "u2", "wwdc", None, '{"title": "K", "transcript": "hello"}', "e", "h"), ("3", "doc", "u3", "wwdc", None, "", "e", "h"), ("4", "sample", "u4", "wwdc", "S", "<p>s</p>", "e", "h")], RAW)
    first = sync.sync(spark, f"file://{tmp_path}/s", raw)
    assert first == {"discover": 4, "normalize": 4, "index": 3, "embed": 3}
    # the record that failed is taken again, and nothing else
    assert sync.sync(spark, f"file://{tmp_path}/s", raw) == {"discover": 0, "normalize": 1, "index": 0, "embed": 0}
    changed = raw.withColumn("etag", F.when(F.col("id") == "1", "e2").otherwise(F.col("etag")))
    assert sync.sync(spark, f"file://{tmp_path}/s", changed)["normalize"] == 2  # the changed one, and the failed one again
    with pytest.raises(ValueError):
        sync.gates({"index": True, "embed": True})


def test_stream_takes_files_once(spark, tmp_path):
    f = "id string, etag string, content_hash string"
    folder = str(tmp_path / "in")
    for part in (["1", "2"], ["2", "3"]):
        spark.createDataFrame([(i, "e", "h") for i in part], f).coalesce(1).write.mode("append").parquet(folder)
        ingest(spark, folder, f, f"file://{tmp_path}/t", str(tmp_path / "cp")).awaitTermination()
    rows = incremental.Target(spark, f"file://{tmp_path}/t").read()
    assert sorted(r["id"] for r in rows.collect()) == ["1", "2", "3"]


def test_embedder():
    v = embedding.hashing_embedder(["a b", "", "a b"])
    assert v.shape == (3, 384) and (v[0] == v[2]).all() and not v[1].any() and abs((v[0] ** 2).sum() - 1) < 1e-6


def test_join_of_classes_with_hot_keys(spark, monkeypatch):
    from heliodor.operators import skew

    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), ("b", 2), ("c", 3), (None, 4)], "k string, v int")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    plain = sorted(tuple(r) for r in rows.join(classes.drop("n"), "k").collect())
    assert skew.hot_size(10) == skew.HOT and skew.hot_size(10**13) == 2 * 10**8
    for hot in (1, 5, 50_000):
        monkeypatch.setattr(skew, "HOT", hot)
        assert sorted(tuple(r) for r in skew.join_classes(rows, classes, ["k"], "n", 1).collect()) == plain
    assert skew.join_classes(rows.where(F.lit(False)), classes, ["k"], "n", 0).count() == 0


def test_targets_add_parts_and_merge_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_PARTS", 3)
    target, want, f = incremental.Target(spark, f"file://{tmp_path}/t"), {}, "id string, etag string, content_hash string, n int"
    rows = lambda ids, n: spark.createDataFrame([(str(i), "e", "h", n) for i in ids], f)
    assert target.publish(rows(range(40), 0)) == 40
    want = {str(i): 0 for i in range(40)}
    for n, (ids, gone) in enumerate([((1, 2), ()), ((2, 50), (3,)), ((), (4, 2)), ((3,), ()), ((5,), ()), ((), ())], 1):
        files = {p.name for p in (tmp_path / "t").iterdir()}
        out = rows(ids, n) if ids else rows((0,), n).where(F.lit(False))
        assert target.publish(out, spark.createDataFrame([(str(i),) for i in gone], "id string")) == len(ids)
        want = {k: v for k, v in want.items() if int(k) not in gone} | {str(i): n for i in ids}
        assert {r["id"]: r["n"] for r in target.read().collect()} == want and target.read().count() == len(want)
        if ids and n != 4:
            added = {p.name for p in (tmp_path / "t").iterdir()} - files
            assert len([p for p in added if p.startswith("p-")]) >= 1
    parts = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("p-")]
    assert len(parts) <= 6  # merged, and what no version since the last but one needs is gone
    target.merge()
    assert {r["id"]: r["n"] for r in target.read().collect()} == want


def test_closure_goes_on_until_nothing_is_new(spark):
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(60)] + [("p60", "p0")], "src_url string, dst_url string")
    got = {r["url"]: r["hops"] for r in graph.closure(chain, spark.createDataFrame([("p0",)], "url string")).collect()}
    assert got == {f"p{i}": i for i in range(61)}


def test_resets_are_confirmed(spark, tmp_path):
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "x").write_bytes(b"1")
    assert not retention.reset(spark, f"file://{tmp_path}/t", False) and (tmp_path / "t" / "deep" / "x").exists()
    assert retention.reset(spark, f"file://{tmp_path}/t", True) and not (tmp_path / "t").exists()
    assert retention.reset(spark, f"file://{tmp_path}/t", True) and retention.prune(spark, f"file://{tmp_path}/none") == {"files": 0, "bytes": 0}
