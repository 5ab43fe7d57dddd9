import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliodor.llm import mixing, packing
from heliodor.llm.tokens import TOKENIZERS, count_tokens, encoding

needs_tokenizer = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_pack_keeps_capacity_and_items(sizes):
    at = packing.pack(sizes, 50)
    fills = {}
    for s, b in zip(sizes, at):
        fills[b] = fills.get(b, 0) + s
    assert all(f <= 50 for f in fills.values()) and len(at) == len(sizes)
    assert len(fills) <= len(packing.first_fit(sizes, 50))


def test_local_search_beats_first_fit():
    bins = [[(6, 0)], [(6, 1)], [(4, 2), (4, 3)], [(4, 4), (1, 5)]]
    better = packing.local_search(bins, 10)
    assert len(better) == 3 and sorted(i for b in better for _, i in b) == list(range(6))
    rng = random.Random(2)
    sizes = [rng.randrange(20, 60) for _ in range(600)]
    assert len(set(packing.pack(sizes, 100))) <= len(packing.first_fit(sizes, 100))


@needs_tokenizer
def test_containers(spark):
    rows = [(1, "word " * 250), (2, "a b c"), (3, None), (4, ""), (None, "x"), (2, "a b c"), (5, "z" * 100)] + [(10 + i, "some words here " * (i % 7 + 1)) for i in range(60)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "k bigint, t string, container string")
    out = packing.fill_containers(df, "k", "t", capacity=100, block=5)
    held = [r.asDict() for r in out.collect()]
    fills = {}
    for r in held:
        if r["container"] is not None:
            fills[r["container"]] = fills.get(r["container"], 0) + r["tokens"]
    assert max(fills.values()) <= 100
    enc = encoding(TOKENIZERS, "byte_bpe_50k.tiktoken")
    want = sum(len(enc.encode_ordinary(t)) for k, t in rows if t and k is not None)
    assert sum(r["tokens"] for r in held) == want
    pieces = sorted((r["piece"], r["first_token"], r["tokens"]) for r in held if r["key"] == 1)
    assert [p[1] for p in pieces] == [0, 100, 200] and [p[2] for p in pieces][:2] == [100, 100]
    assert sum(r["key"] == 2 for r in held) == 2 and {r["container"] for r in held if r["key"] in (3, 4)} == {None}
    assert packing.fill_containers(df.where(F.lit(False)), "k", "t").count() == 0


@needs_tokenizer
def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "<|endoftext|> ordinary"), (2, None)], "k bigint, t string")
    assert dict(tuple(r) for r in count_tokens(rows, "k", "t").collect())[2] == 0


def test_weights():
    shares = {"a": 0.8, "b": 0.15, "c": 0.05}
    assert mixing.temperature_weights(shares, 1.0) == pytest.approx(shares)
    assert set(mixing.temperature_weights(shares, 0.0).values()) == {1 / 3}
    e = mixing.exponent_for_entropy(shares, 0.9)
    assert mixing.entropy(mixing.temperature_weights(shares, e)) == pytest.approx(0.9, abs=1e-6)
    plan = mixing.plan({"a": 800, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert plan["a"] == pytest.approx((0.5, 300)) and plan["b"] == pytest.approx((0.5, 300))
    tight = mixing.plan({"a": 800, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, budget=800)
    assert tight["b"][1] == pytest.approx(300, rel=1e-6) and tight["a"][1] == pytest.approx(500, rel=1e-6)
    assert mixing.plan({}, {"a": (1.0, 1)}) == {"a": (0.0, 0.0)}


def test_exponents_are_bisected():
    have, targets = {"a": 800, "b": 150, "c": 50}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 4)}
    exponent, given = mixing.settle(have, targets, budget=700)
    assert 0 < exponent < 1 and sum(t for _, t in given.values()) == pytest.approx(700)
    assert max(given[s][1] / (have[s] * targets[s][1]) for s in have) == pytest.approx(1, rel=1e-6)  # a limit is reached, none exceeded
    brute = max(a / 10_000 for a in range(10_001) if all(w * 700 <= have[s] * targets[s][1] for s, w in mixing.temperature_weights({s: n / 1000 for s, n in have.items()}, a / 10_000, {s: t for s, (t, _) in targets.items()}).items()))
    assert exponent == pytest.approx(brute, abs=1e-4)
    exponent, given = mixing.settle(have, targets, target_entropy=1.0)
    assert mixing.entropy({s: w for s, (w, _) in given.items()}) == pytest.approx(1.0, abs=1e-6) and exponent < 1
    assert all(given[s][1] <= have[s] * targets[s][1] * (1 + 1e-9) for s in have)


def test_local_search_empties_containers_that_best_fit_leaves():
    """Containers before and after the search, beside the least number that the sizes allow."""
    rng, before, after, least = random.Random(8), 0, 0, 0
    for _ in range(30):
        sizes = [rng.randint(200, 350) for _ in range(150)]
        before, after, least = before + len(packing.first_fit(sizes, 1000)), after + len(set(packing.pack(sizes, 1000))), least - (-sum(sizes) // 1000)
    assert least <= after < before and after - least <= 0.2 * (before - least)


@needs_tokenizer
def test_containers(spark):
    rows = [(1, "word " * 250), (2, "a b c"), (3, None), (4, ""), (None, "x"), (2, "a b c"), (5, "z" * 100)] + [(10 + i, "some words here " * (i % 7 + 1)) for i in range(60)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "k bigint, t string, container string")
    out = packing.fill_containers(df, "k", "t", capacity=100, block=5)
    held = [r.asDict() for r in out.collect()]
    fills = {}
    for r in held:
        if r["container"] is not None:
            fills[r["container"]] = fills.get(r["container"], 0) + r["tokens"]
    assert max(fills.values()) <= 100
    enc = encoding(TOKENIZERS, "byte_bpe_50k.tiktoken")
    want = sum(len(enc.encode_ordinary(t)) for k, t in rows if t and k is not None)
    assert sum(r["tokens"] for r in held) == want
    pieces = sorted((r["piece"], r["first_token"], r["tokens"]) for r in held if r["key"] == 1)
    assert [p[1] for p in pieces] == [0, 100, 200] and [p[2] for p in pieces][:2] == [100, 100]
    assert sum(r["key"] == 2 for r in held) == 2 and {r["container"] for r in held if r["key"] in (3, 4)} == {None}
    assert packing.fill_containers(df.where(F.lit(False)), "k", "t").count() == 0


@needs_tokenizer
def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "<|endoftext|> ordinary"), (2, None)], "k bigint, t string")
    assert dict(tuple(r) for r in count_tokens(rows, "k", "t").collect())[2] == 0


def test_weights():
    shares = {"a": 0.8, "b": 0.15, "c": 0.05}
    assert mixing.temperature_weights(shares, 1.0) == pytest.approx(shares)
    assert set(mixing.temperature_weights(shares, 0.0).values()) == {1 / 3}
    e = mixing.exponent_for_entropy(shares, 0.9)
    assert mixing.entropy(mixing.temperature_weights(shares, e)) == pytest.approx(0.9, abs=1e-6)
    plan = mixing.plan({"a": 800, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert plan["a"] == pytest.approx((0.5, 300)) and plan["b"] == pytest.approx((0.5, 300))
    tight = mixing.plan({"a": 800, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, budget=800)
    assert tight["b"][1] == pytest.approx(300, rel=1e-6) and tight["a"][1] == pytest.approx(500, rel=1e-6)
    assert mixing.plan({}, {"a": (1.0, 1)}) == {"a": (0.0, 0.0)}


def test_exponents_are_bisected():
    have, targets = {"a": 800, "b": 150, "c": 50}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 4)}
    exponent, given = mixing.settle(have, targets, budget=700)
    assert 0 < exponent < 1 and sum(t for _, t in given.values()) == pytest.approx(700)
    assert max(given[s][1] / (have[s] * targets[s][1]) for s in have) == pytest.approx(1, rel=1e-6)  # a limit is reached, none exceeded
    brute = max(a / 10_000 for a in range(10_001) if all(w * 700 <= have[s] * targets[s][1] for s, w in mixing.temperature_weights({s: n / 1000 for s, n in have.items()}, a / 10_000, {s: t for s, (t, _) in targets.items()}).items()))
    assert exponent == pytest.approx(brute, abs=1e-4)
    exponent, given = mixing.settle(have, targets, target_entropy=1.0)
    assert mixing.entropy({s: w for s, (w, _) in given.items()}) == pytest.approx(1.0, abs=1e-6) and exponent < 1
    assert all(given[s][1] <= have[s] * targets[s][1] * (1 + 1e-9) for s in have)


@needs_tokenizer
def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(5, 40), s) for i, s in enumerate(["docs"] * 1500 + ["Talks "] * 300 + ["talk-s"] * 100 + ["web_pages"] * 50 + [None] * 20 + ["unknown thing"] * 20)]
    rows += [(None, "x", "docs"), (9999, None, "docs"), (9998, "", "docs")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "k bigint, t string, s string, key string")
    targets = spark.createDataFrame([("docs", 0.5, 1), ("talks", 0.4, 2), ("web-pages", 0.1, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs, targets, "k", "t", "s")
    got = {r["source"]: r for r in report.collect()}
    for s, share in (("docs", 0.5), ("talks", 0.4), ("web-pages", 0.1)):
        assert got[s]["share"] == pytest.approx(share, abs=0.005) and got[s]["repeats"] <= got[s]["max_repeats"] + 1e-9
    most = mixed.groupBy("key").agg(F.max("epoch").alias("e"), F.count("*").alias("n"), F.count_distinct("epoch").alias("d"), F.any_value("source").alias("source")).collect()
    assert all(r["n"] == r["d"] for r in most)
    assert max(r["e"] for r in most if r["source"] == "talks") <= 2
    assert mixed.where("key >= 9000").count() == 0
    empty, none = mixing.mix(docs.where(F.lit(False)), targets, "k", "t", "s")
    assert empty.count() == 0 and none.count() == 4


def test_local_search_tries_every_partner():
    """Whatever number of fuller containers come first, and none of them helps; then all pairs by brute force."""
    bins = [[(9, i)] for i in range(300)] + [[(7, 300)], [(2, 301)]]
    assert len(packing.local_search(bins, 10)) == 301
    rng = random.Random(5)
    sizes = [rng.randint(1100, 1900) for _ in range(800)]
    bins = [[s for s, _ in b] for b in packing.local_search(packing.first_fit(sizes, 4096), 4096)]
    assert sorted(s for b in bins for s in b) == sorted(sizes) and -(-sum(sizes) // 4096) < len(bins) < len(packing.first_fit(sizes, 4096))
    assert sum(sum(b) < 4096 for b in bins) > 200
    for i, donor in enumerate(bins):
        taken = [*donor, *(a + b for k, a in enumerate(donor) for b in donor[:k])]
        for j, partner in enumerate(bins):
            if i != j and sum(donor) <= sum(partner):
                assert not any(0 < t - g <= 4096 - sum(partner) for t in taken for g in (0, *partner))
