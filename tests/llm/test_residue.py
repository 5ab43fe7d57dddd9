import random

import pytest
from pyspark.sql import functions as F

from heliodor.llm import residue

PROSE = [
    "Use the list view to show rows of data. When the model changes, the view draws its rows again and keeps the selection.",
    "If the server answers with 404 Not Found, the cache shows the last page. Catch 503 Service Unavailable in the loader and try again after 8 seconds.",
    "Learn how to measure the time that a request takes and how to cancel it. Each session owns one queue and up to eight buffers.",
    "The framework updates layers lazily while the window is visible. To animate a menu, create a handler and pass it to the view.",
] * 20


@pytest.fixture(scope="module")
def models():
    return residue.fit(PROSE)


@pytest.mark.parametrize(
    "text",
    [
        "Lorem ipsum dolor sit amet, consectetur elit sed risus.", "Good text comes first here.\n\n{{ page.title }} and more.", "<%= doc.text %>", "%%TITLE%% Something real.", "__ABSTRACT__ Something.", "Hello %FIRST_NAME%, welcome.",
        "<#Add a summary#>", "[TODO: write this part]", "TODO(docs): explain how it works.", "See ${topic} for more.", "404 Not Found", "This page requires JavaScript.\nPlease enable JavaScript.", "Your session has expired. Log in again to see this content.",
        "Access denied.\nYou don't have permission to view this resource.", "Our site is down for maintenance. Please come back later.", "null", "# Title\n\nundefined", "[00:00:01] N/A", "[object Object]", "[00:00:00] Page introuvable (404)", "Text goes here. Text text text text.", "xxxx XXX xxxx XXX xxxx",
        "The framework updates layers lazily while the window is visible.\n\nPlease turn on JavaScript in your browser and refresh the page to view its content.",
    ],
)
def test_residue(models, text):
    assert residue.residue_reason(text, models)


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "Deprecated.", "A template such as `{{ item.title }}` is filled in by the engine.", "```html\n<p>${name}</p>\n```\nThe snippet keeps its variable until the engine runs.", *PROSE[:4],
        "The value is undefined until the call returns, so check for null first.", "Typesetters call filler text lorem ipsum; the layout measures real columns instead.", "Update the layers. " * 400,
    ],
)
def test_real_text(models, text):
    assert residue.residue_reason(text, models) is None


def test_residue_in_the_sample_teaches_nothing():
    polluted = residue.fit([*PROSE, "xxxx XXX XXX xxxx xxxx XXX XXX", "Lorem ipsum dolor sit amet risus velit", "404 Not Found\nCheck the address and try again."])
    for text in ("xxxx XXX xxxx XXX xxxx", "Lorem ipsum velit risus dolor sit amet elit", "404 Not Found", "null\nnull"):
        assert residue.residue_reason(text, polluted), text


def test_table(spark, models):
    rows = [("a", "null", "x"), ("a", "null", "x"), ("b", None, "x"), (None, "null", "x"), ("c", "", None), ("d", PROSE[0], "x")]
    df = spark.createDataFrame(rows, "k string, t string, key string")
    b = spark.sparkContext.broadcast(models)
    assert [tuple(r) for r in residue.find_residue(df, "k", "t", b).collect()] == [("a", "empty value")] * 2
    assert residue.find_residue(df.where(F.lit(False)), "k", "t", b).count() == 0
    two = df.select("k", F.col("key").alias("reason"), F.lit(1).alias("n"), "t")
    assert [tuple(r) for r in residue.find_residue(two, ("k", "n"), "t", b).distinct().collect()] == [("a", 1, "empty value")]


def test_prose_is_counted_over_whole_texts(spark):
    known = residue.Residue()
    texts = [*PROSE, None, "", "Far into the text. " * 5000 + "The shuttle lands."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    counted, plain = residue.count_prose(df, "t", known), known.count([t for t in texts if t is not None])
    assert all((counted[n] == plain[n]).all() for n in plain)
    empty = residue.count_prose(df.where(F.lit(False)), "t", known)
    assert residue.residue_reason("404 Not Found", known.fit(empty)) and not residue.residue_reason(PROSE[0], known.fit(empty))


def test_long_fields_of_empty_values():
    talk = "WEBVTT\n\n" + "".join(f"{i}\n00:{i // 60:02d}:{i % 60:02d}.000 --> 00:{i // 60:02d}:{i % 60:02d}.900\nnull\n\n" for i in range(600))
    assert residue.is_empty_value(talk) and not residue.is_empty_value(talk + "words at the end")


def test_held_out_sentences(models):
    """Sentences of the wordings that weren't drawn for the models."""
    rng, drawn = random.Random(99), set(residue.bank(residue.NOTICES) + residue.bank(residue.FILLER))
    fresh = {residue.draw(w, rng) for family in (residue.NOTICES, residue.FILLER) for wordings in family.values() for w in wordings for _ in range(40)} - drawn
    fresh = [s for s in fresh if len(s) >= 8]
    assert len(fresh) > 500 and sum(residue.residue_reason(s, models) is not None for s in fresh) >= 0.95 * len(fresh)
