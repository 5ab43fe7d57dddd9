import numpy as np
from pyspark.sql import functions as F

from heliodor.llm.neighbours import nearest_vectors


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x.astype(np.float64)):
        d = ((x - v) ** 2).sum(1)
        out[i] = [j for _, j in sorted((a, b) for a, b in zip(d, ids) if b != i)[:k]]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.round(centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 32)), 2).astype(np.float32)
    x[700:712] = x[0]
    ids = list(range(1, 1501))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "k bigint, e array<float>")
    found = nearest_vectors(df, "k", "e", 5, dimension=32, block=100)
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    want = brute(ids, x, 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 1500
    hits = sum(len({n for n, _ in got[i].values()} & set(want[i])) for i in ids)
    assert hits / (5 * 1500) >= 0.97
    assert [got[1][r][0] for r in range(1, 6)] == want[1] == [701, 702, 703, 704, 705]
    assert [got[701][r][0] for r in range(1, 6)] == want[701]
    some = nearest_vectors(df, "k", "e", 5, dimension=32, block=100, ask_every=20)
    assert {(r["key"], r["rank"], r["neighbour"]) for r in some.collect()} == {(i, r, n) for i in ids if i % 20 == 0 for r, (n, _) in got[i].items()}
    assert all(abs(d - np.linalg.norm(x[i - 1].astype(float) - x[n - 1])) < 1e-6 for i in ids[:50] for n, d in got[i].values())


def test_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "a"), (3, [1.0], "a"), (4, [0.0, 0.0], "a"), (5, [float("nan"), 1.0], "a"), (None, [1.0, 0.0], "a"), (6, [1.0, None], "a"), (7, [0.0, 2.0], None)]
    df = spark.createDataFrame(rows, "k bigint, e array<float>, key string")
    assert sorted((r["key"], r["neighbour"]) for r in nearest_vectors(df, "k", "e", 5, dimension=2).collect()) == [(1, 7), (7, 1)]
    assert nearest_vectors(df.where(F.lit(False)), "k", "e", 5, dimension=2).count() == 0
    assert nearest_vectors(df.where("k = 7"), "k", "e", 5, dimension=2).count() == 0


def test_packing_loses_nothing():
    from heliodor.llm.neighbours import _matrix, _pack
    import pandas as pd

    for v in ([0.25, -0.0009765625, 1.0], [0.1, 1e30, -3.3], [65504.0, 0.5, 1e-9]):
        x = np.asarray(v, np.float32)
        assert (_matrix(pd.Series([_pack(x)]), 3)[0] == x).all()
    assert len(_pack(np.asarray([0.25, 0.5], np.float32))) == 4 and len(_pack(np.asarray([0.1, 0.5], np.float32))) == 8
