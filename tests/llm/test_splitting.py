import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliodor.llm.splitting import spans, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#!é́。", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    cut = spans(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cut)
    assert all(nxt[0] == max(prev[0], prev[1] - overlap) and nxt[1] > prev[1] for prev, nxt in zip(cut, cut[1:]))
    assert "".join([text[cut[0][0] : cut[0][1]]] + [text[p[1] : n[1]] for p, n in zip(cut, cut[1:])]) == text


def test_natural_places():
    text = "# A\n" + "One two. " * 8 + "\n\n" + "Three four. " * 8 + "\n# B\n" + "Five six. " * 8
    cut = [text[a:b] for a, b in spans(text, 110, 0)]
    assert [c.split("\n")[0].strip() for c in cut] == ["# A", "Three four. " * 7 + "Three four.", "# B"]
    words = [w for a, b in spans("alpha beta gamma delta " * 20, 50, 0) for w in ("alpha beta gamma delta " * 20)[a:b].split()]
    assert set(words) == {"alpha", "beta", "gamma", "delta"}
    assert [b - a for a, b in spans("x" * 25, 10, 2)] == [10, 10, 9]
    assert spans("", 10, 2) == [(0, 0)]
    with pytest.raises(ValueError):
        spans("x", 5, 5)


def test_very_long_text_is_quick():
    assert len(spans("word " * 400_000, 10_000, 200)) > 200
    assert len(spans("x" * 2_000_000, 10_000, 200)) > 200


def test_table(spark):
    rows = [(1, "x" * 25, "k"), (2, "x" * 10, "k"), (3, None, None), (None, "x" * 25, "k"), (1, "x" * 25, "k"), (4, "", "k"), (5, "😀" * 11, "k")]
    df = spark.createDataFrame(rows, "id bigint, t string, piece string")
    out = split_oversized(df, "id", "t", 10, 2)
    assert sorted((r["key"], r["chunk_index"], len(r["piece"])) for r in out.distinct().collect()) == [(1, 0, 10), (1, 1, 10), (1, 2, 9), (5, 0, 10), (5, 1, 3)]
    assert {r["pieces"] for r in out.where("key = 1").collect()} == {3} and out.where("key = 1").count() == 6
    assert split_oversized(df.where(F.lit(False)), "id", "t").count() == 0
