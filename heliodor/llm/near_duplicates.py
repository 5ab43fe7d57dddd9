"""Problem 2: records that share most of their text, by banded MinHash with odd-sketch verification.

A text's word shingles give `bands * rows` MinHash samples. Their bands propose candidate pairs; the same samples are folded
into a parity bitmap (odd sketch), and the number of differing bits of two bitmaps estimates the similarity closely where it
is high. Candidates whose estimate is far below the threshold are dropped, the rest are settled exactly on their shingles.

Texts with the same words form one class, so any number of copies costs one signature. With 160 samples in 40 bands of 4, a
pair at similarity 0.7 is proposed with probability 0.99998; unrelated texts (similarity 0.05) with 0.0003.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.words import WORD, WordHashes, shingle_hashes
from heliodor.operators.skew import HOT, join_classes
from heliodor.session import materialise, spread
from heliodor.sources.tables import read

#: Bits of the parity bitmap.
SKETCH_BITS = 512
_BLOCK = 4096
#: Keys of a band that one task pairs with each other.
BAND_BLOCK = 2_000


def _signer(size: int, least_words: int, bands: int, rows: int, seed: int):
    k = bands * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
        of_band = rng.integers(1, 2**63, (rows, bands), dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        table = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["key"], batch["text"]):
                words = WORD.findall(text.lower()) if text else []
                if len(words) < least_words:
                    continue
                h = shingle_hashes(words, size, table)
                if not len(h):
                    continue
                x = (h >> np.uint64(32)).astype(np.uint32)
                m = np.full(k, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), _BLOCK):
                    np.minimum(m, (x[at : at + _BLOCK, None] * a + b).min(axis=0), out=m)
                m64 = m.astype(np.uint64)
                keys = (m64.reshape(bands, rows).T * of_band).sum(axis=0, dtype=np.uint64)
                keys = ((keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.arange(bands, dtype=np.uint64)
                bit = (((m64 + np.uint64(1)) * salt) >> np.uint64(40)) % np.uint64(SKETCH_BITS)
                parity = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
                same = xxhash.xxh3_128_digest(" ".join(words))
                out.append((key, same, xxhash.xxh3_128_digest(text), keys.view(np.int64), np.packbits(parity).view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "same", "equal", "bands", "sketch"])

    return sign


def signatures(df: DataFrame, key: str, text: str, size: int, least_words: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """(key, same, equal, bands, sketch) of every text with at least `least_words` words and one shingle. Null keys and texts have none."""
    rows_in = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return spread(rows_in, "key").mapInPandas(_signer(size, least_words, bands, rows, seed), "key bigint, same binary, equal binary, bands array<bigint>, sketch array<bigint>")


def estimate(sketch_a: Column, sketch_b: Column, samples: int) -> Column:
    """Similarity estimated from two odd sketches of `samples` MinHash samples each."""
    differ = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    inside = F.greatest(F.lit(1e-9), 1 - 2 * differ / F.lit(float(SKETCH_BITS)))
    return 1 + F.lit(SKETCH_BITS / (4.0 * samples)) * F.log(inside)


def _exact(size: int, threshold: float):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, frozenset] = {}

        def shingles(key: int, text: str) -> frozenset:
            if key not in kept:
                if len(kept) > 2000:
                    kept.clear()
                w = WORD.findall(text.lower())
                kept[key] = frozenset(zip(*(w[i:] for i in range(size))))
            return kept[key]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                x, y = shingles(a, ta), shingles(b, tb)
                both = len(x & y)
                similarity = both / (len(x) + len(y) - both)
                if similarity >= threshold:
                    out.append((a, b, similarity))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return check


class NearDuplicates:
    """The result of `near_duplicates`.

    members: (key, rep, first): each text with the smallest key of the texts with exactly its words, and of those equal to it.
    links: (a, b, similarity): pairs of reps, a < b, at or above the threshold.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def classes(self) -> DataFrame:
        """One row per text: (key, rep, copies, links): size of its class and number of other classes linked to it."""
        ends = self.links.select(F.col("a").alias("rep")).unionAll(self.links.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        return self.members.join(sizes.join(degree, "rep", "left").na.fill(0, ["links"]), "rep").select("key", "rep", "copies", "links")

    def pairs(self, expand: int = 32) -> DataFrame:
        """(a, b) of keys, a < b.

        Up to `expand` equal texts take part each for itself. Of more, the first takes part, beside the pairs (first, copy), so
        the output grows in step with the rows whatever number of copies a text has. Texts of the same words that differ
        in case, punctuation or layout are different texts: all pairs of them are given, and all their links.
        """
        groups = self.members.groupBy("rep", "first").agg(F.count("*").alias("copies"))
        several = groups.groupBy("rep").agg(F.sum("copies").alias("of_class")).where("of_class > 1")
        many = self.members.join(groups.join(several, "rep").select("rep", "first", "copies"), ["rep", "first"])
        stand_ins = many.where((F.col("copies") <= expand) | (F.col("key") == F.col("first"))).select("rep", "key")
        inside = stand_ins.alias("x").join(stand_ins.alias("y"), F.col("x.rep") == F.col("y.rep")).where("x.key < y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        stars = many.where((F.col("copies") > expand) & (F.col("key") > F.col("first"))).select(F.col("first").alias("a"), F.col("key").alias("b"))
        across = (
            self.links.join(stand_ins.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a", "left")
            .join(stand_ins.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b", "left")
            .select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        return inside.unionAll(stars).unionAll(across)


def _proposed(banded: DataFrame, total: int, block: int = BAND_BLOCK) -> DataFrame:
    """(a, b), a < b: the pairs of keys that share a band of `banded` (key, band), which has each row once; repeats kept.

    Most bands have one key or two, and are settled by the least and the greatest. Of a band with more keys than `block` (or the bound
    of hot keys, if greater) the keys are cut into blocks by their hash, and each pair of blocks is a task's share of its own.
    """
    most = max(block, total // HOT)
    bands = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where("n > 1")
    bands = materialise(bands, "bands")
    held = banded.join(bands.where("n > 2").select("band", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "band")
    held = held.withColumn("own", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
    x = held.select("band", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), F.col("key").alias("x"))
    y = held.select("band", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("key").alias("y"))
    both = x.join(y, ["band", "i", "j"]).where("i < j AND x != y OR x < y")
    return bands.where("n = 2").select("a", "b").unionAll(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_duplicates(
    df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 40, rows: int = 4, margin: float | None = None, seed: int = 7
) -> NearDuplicates:
    """Texts of `df` whose sets of `size`-word shingles have a Jaccard similarity of at least `threshold`.

    `key` is a unique integer. Null keys, null texts and texts with fewer than `least_words` words or no shingle take no part.
    Repeated keys with the same text count once; an empty table gives empty results; other columns are ignored.
    `margin` is how far below the threshold an estimate may fall; by default five standard deviations of the estimate.
    """
    samples = bands * rows
    if margin is None:
        margin = 5 * math.sqrt(threshold * (1 - threshold) / samples + SKETCH_BITS / (16 * samples**2) * (math.exp(4 * samples * (1 - threshold) / SKETCH_BITS) - 1) / 2)
    signed = materialise(signatures(df, key, text, size, least_words, bands, rows, seed), "signatures")
    firsts = signed.groupBy("same", "equal").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    reps = firsts.groupBy("same").agg(F.min("first").alias("rep"), F.count("*").alias("m"))
    total = signed.count()
    named = materialise(join_classes(firsts, reps, ["same"], "m", total), "classes")
    members = materialise(join_classes(signed.select("key", "same", "equal").distinct(), named, ["same", "equal"], "n", total).select("key", "rep", "first"), "members")
    one_each = signed.join(members.where("key = rep").select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    one_each = materialise(one_each, "one-each")

    proposed = _proposed(one_each.select("key", F.explode("bands").alias("band")), total * bands).distinct()
    sketches = one_each.select("key", "sketch")
    judged = (
        proposed.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(estimate(F.col("sa"), F.col("sb"), samples) >= threshold - margin)
        .select("a", "b")
        .distinct()
    )
    judged = materialise(judged, "candidates")
    needed = judged.select(F.col("a").alias("key")).unionAll(judged.select("b")).distinct()
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).join(needed, "key", "left_semi").dropDuplicates(["key"])
    texts = materialise(texts, "texts")
    with_texts = judged.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    links = with_texts.select("a", "b", "text_a", "text_b").mapInPandas(_exact(size, threshold), "a bigint, b bigint, similarity double")
    return NearDuplicates(members, materialise(links, "links"))


def _of_content(spark: SparkSession, root: str) -> NearDuplicates:
    content = read(spark, root, "content").select("content_rowid", "body")
    return near_duplicates(content, "content_rowid", "body", size=3, threshold=0.7, least_words=80)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _of_content(spark, root).pairs().select(F.col("a").alias("content_rowid_a"), F.col("b").alias("content_rowid_b")).distinct()


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row per content row of at least 80 words: its class, the class's copies and its links to other classes."""
    return _of_content(spark, root).classes().select(F.col("key").alias("content_rowid"), F.col("rep").alias("class_id"), "copies", "links")


P2_FOUND_SQL = r"""
WITH w AS (SELECT content_rowid AS r, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM content WHERE body IS NOT NULL),
  s AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 80)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2)
SELECT x AS content_rowid_a, y AS content_rowid_b FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE c >= 0.7 * (nx.n + ny.n - c)
"""

P2_CLASSES_SQL = r"""
WITH w AS (SELECT content_rowid AS r, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM content WHERE body IS NOT NULL),
  m AS (SELECT r, w, min(r) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM w WHERE len(w) >= 80),
  s AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE r = rep)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
  d AS (SELECT x, count(*) AS links FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE c >= 0.7 * (nx.n + ny.n - c) GROUP BY x)
SELECT m.r AS content_rowid, m.rep AS class_id, m.copies, coalesce(d.links, 0) AS links FROM m LEFT JOIN d ON d.x = m.rep
"""
