from heliodor.operators import incremental
from heliodor.streaming.ingest import ingest


def test_latest_version_of_a_batch_is_kept(spark, tmp_path):
    f, folder = "id string, etag string, content_hash string, fetched_at bigint", str(tmp_path / "in")
    order = [("a", 1), ("c", 3), ("b", 2)]
    rows = [(str(i), etag, f"h{etag}", at) for i in range(20) for etag, at in (order if i % 2 else order[::-1])]
    spark.createDataFrame(rows, f).coalesce(1).write.parquet(folder)
    ingest(spark, folder, f, f"file://{tmp_path}/t", str(tmp_path / "cp")).awaitTermination()
    target = incremental.Target(spark, f"file://{tmp_path}/t")
    assert sorted((r["id"], r["etag"]) for r in target.read().collect()) == sorted((str(i), "c") for i in range(20))
    # the version the target holds comes again beside a later one, and the later one is taken
    spark.createDataFrame([("0", "d", "hd", 4), ("0", "c", "hc", 3), ("1", "c", "hc", 3)], f).coalesce(1).write.mode("append").parquet(folder)
    ingest(spark, folder, f, f"file://{tmp_path}/t", str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: r["etag"] for r in target.read().collect()}
    assert got["0"] == "d" and got["1"] == "c" and len(got) == 20
    # an older version that arrives late doesn't replace a newer one
    spark.createDataFrame([("0", "b", "hb", 2), ("1", "e", "he", 5)], f).coalesce(1).write.mode("append").parquet(folder)
    ingest(spark, folder, f, f"file://{tmp_path}/t", str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: r["etag"] for r in target.read().collect()}
    assert got["0"] == "d" and got["1"] == "e" and len(got) == 20
