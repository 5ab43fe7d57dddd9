import random

import numpy as np
from pyspark.sql import functions as F

from heliodor.llm.near_duplicates import near_duplicates
from heliodor.llm.words import WORD, WordHashes, shingle_hashes


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = {}
    for i in range(0, 300, 3):
        base = rng.choices(vocabulary, k=150)
        out[i] = " ".join(base)
        edited = list(base)
        for _ in range(rng.randrange(0, 30)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        out[i + 1] = " ".join(edited)
        out[i + 2] = out[i] if i % 2 else " ".join(rng.sample(base, len(base)))
    return out


def brute(rows, size, threshold, least=1):
    sets = {}
    for k, t in rows.items():
        w = WORD.findall((t or "").lower())
        if len(w) >= max(least, size):
            sets[k] = set(zip(*(w[i:] for i in range(size))))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(rows.items()), "k bigint, t string")
    for size, threshold in ((3, 0.7), (5, 0.8)):
        found = near_duplicates(df, "k", "t", size, threshold).pairs()
        assert {(r["a"], r["b"]) for r in found.collect()} == brute(rows, size, threshold)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", 0, "q"), (2, "A, b; c d e f!", 1, "q"), (3, None, 2, "q"), (4, "", 3, "q"), (None, "a b c d e f", 4, "q"), (5, "a b", 5, "q"), (6, long, 6, "q"), (7, long + " y", 7, None), (1, "a b c d e f", 0, "q")]
    df = spark.createDataFrame(rows, "k bigint, t string, a bigint, key string")
    found = near_duplicates(df, "k", "t", 3, 0.7)
    assert sorted((r["a"], r["b"]) for r in found.pairs().distinct().collect()) == [(1, 2), (6, 7)]
    assert {r["key"]: (r["rep"], r["links"]) for r in found.classes().collect()} == {1: (1, 0), 2: (1, 0), 6: (6, 1), 7: (7, 1)}
    assert near_duplicates(df.where(F.lit(False)), "k", "t").pairs().count() == 0


def test_many_copies_stay_linear(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, base) for i in range(200)] + [(200 + i, base + " last") for i in range(100)]
    found = near_duplicates(spark.createDataFrame(rows, "k bigint, t string"), "k", "t", 3, 0.7)
    pairs = {(r["a"], r["b"]) for r in found.pairs().collect()}
    assert pairs == {(0, i) for i in range(1, 200)} | {(200, i) for i in range(201, 300)} | {(0, 200)}
    assert found.classes().groupBy("rep", "copies", "links").count().count() == 2


def test_shingles_tell_order_and_repeats():
    table = WordHashes(most=2)
    a, b = shingle_hashes(["x", "y", "z"], 3, table), shingle_hashes(["z", "y", "x"], 3, table)
    assert len(a) == 1 and a[0] != b[0] and not len(shingle_hashes(["x"], 3, table))
    assert len(np.unique(shingle_hashes(["x", "y"] * 5, 2, table))) == 2


def test_different_texts_of_the_same_words_are_all_paired(spark):
    words = [f"w{i}" for i in range(100)]
    body, near = " ".join(words), " ".join([*words[:-1], "other"])
    texts = {i: body for i in range(1, 35)} | {35: body.upper(), 36: body.replace(" ", "\n"), 37: near}
    found = near_duplicates(spark.createDataFrame(list(texts.items()), "key bigint, text string"), "key", "text", size=3)
    star = {(1, i) for i in range(2, 35)}
    assert sorted(map(tuple, found.pairs().collect())) == sorted(star | {(1, 35), (1, 36), (35, 36), (1, 37), (35, 37), (36, 37)})
    assert found.pairs(40).count() == 37 * 36 // 2


def test_crowded_bands_give_the_same_pairs(spark):
    from heliodor.llm.near_duplicates import _proposed

    rows = [(k, b) for b in (1, 2) for k in range(30)] + [(k, 3) for k in range(25, 33)] + [(40, 4)]
    want = sorted({(a, b) for a, x in rows for b, y in rows if x == y and a < b})
    df = spark.createDataFrame(rows, "key bigint, band bigint")
    for block in (2, 7, 100):
        got = [tuple(r) for r in _proposed(df, len(rows), block).collect()]
        assert sorted(set(got)) == want and len(got) == len([1 for a, x in rows for b, y in rows if x == y and a < b])
