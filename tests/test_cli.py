import json

import pytest

from heliodor import cli


@pytest.mark.parametrize(("value", "limit"), [("5.7", 5), ("10abc", 10), (" 7", 7), ("abc", 20), ("", 20), (None, 20), ("0", 20), ("-3", -3), (8, 8)])
def test_limits(value, limit):
    assert cli.parse_limit(value) == limit


def test_status_as_text():
    held = {"byType": {"doc": 1234567, "talk": 3}, "byStatus": {"a-long-status": 5}, "total": 1234570, "indexed": 2, "recentFailures": [{"title": None, "url": "u"}, {"title": "T", "url": "v"}]}
    out = cli.status_text(held)
    assert "  │ doc        │ 1,234,567 │" in out and "  │ a-long-status │       5 │" in out
    assert out.endswith("Total resources: 1,234,570\nIndexed documents: 2\n\nRecent failures:\n  - u\n  - T")


def test_commands(spark, small, capsys, tmp_path):
    def run(*args, **how):
        code = cli.main(["--root", small, *args], **how)
        return code, capsys.readouterr().out

    code, out = run("status")
    held = json.loads(out)
    assert code == 0 and sum(held["byType"].values()) == held["total"] and len(held["recentFailures"]) <= 10
    assert run("--human", "status")[1].startswith("=== Status ===")
    assert len(json.loads(run("search", "view", "--limit", "3x")[1])) <= 3
    from heliodor.sources.tables import read

    one = read(spark, small, "content").join(read(spark, small, "manifest").select("id", "url"), "id").select("id").first()["id"]
    assert json.loads(run("show", one)[1])[0]["id"] == one
    opened = []
    assert run("open", one, browse=opened.append)[0] == 0 and len(opened) == 1
    assert run("show", "nothing")[0] == run("open", "nothing", browse=opened.append)[0] == 1 and len(opened) == 1
    (tmp_path / "x").write_bytes(b"12")
    assert json.loads(run("prune", str(tmp_path), "--dry-run")[1]) == {"files": 1, "bytes": 2}
    records = str(tmp_path / "records")
    spark.createDataFrame([("1", "code_file", "u", "x", "T", "int a;", "e", "h")], "id string, type string, url string, source string, title string, payload string, etag string, content_hash string").write.parquet(records)
    root = f"file://{tmp_path}/tables"
    assert cli.main(["--root", root, "sync", records]) == 0 and json.loads(capsys.readouterr().out)["embed"] == 1
    assert cli.main(["--root", root, "reset"], ask=lambda _: "no") == 0 and (tmp_path / "tables").exists() and not json.loads(capsys.readouterr().out)["reset"]
    assert cli.main(["--root", root, "reset"], ask=lambda _: "Confirm") == 0 and not (tmp_path / "tables").exists()
