"""Problem 3: the nearest vectors of every vector, by an inverted file with product-quantised residuals.

Coarse centroids split the vectors into cells. Each vector is kept as the product-quantised code of its residual; a query
visits its `probes` nearest cells, ranks their codes by asymmetric distance tables and settles the best `shortlist` of each cell
exactly. Equal vectors count once: one of each is indexed, and their ids are put back at the end.

The centroids and codebooks are fitted on a bounded sample; every vector is indexed. The number of cells follows the number
of vectors, so a cell's size doesn't grow with the table; a cell that is still too large is cut into blocks that
all of the cell's queries visit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.operators.skew import join_classes
from heliodor.session import materialise, spread
from heliodor.sources.tables import read

#: The most vectors the index is fitted on.
FIT_SAMPLE = 20_000
#: Vectors per coarse cell that the number of cells aims at, and the most in one block of a cell.
CELL, BLOCK = 120, 2_000
#: The most coarse centroids, so that they and the distances to them fit a task whatever the table's size.
MOST_CELLS = 16_384
PROBES = 3
#: Distances within this share of the vectors' squares are compared in double precision.
_SLACK = 1e-4
#: Exact distances computed at once, and more than that only for one query.
_EXACT = 8_192
#: Bytes of a code, centroids of each sub-quantiser, and exact checks per query and block.
CODE, BOOK, SHORTLIST = 48, 256, 160


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest rows of c for each row of x, by blocks."""
    cc, n = (c * c).sum(1), min(n, len(c))
    out = np.empty((len(x), n), np.int32)
    for at in range(0, len(x), 512):
        d = cc - 2 * (x[at : at + 512] @ c.T)
        if n == 1:
            out[at : at + 512, 0] = d.argmin(1)
            continue
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        out[at : at + 512] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
        c[held] = (sums / np.diff(np.append(first, len(x)))[:, None]).astype(np.float32)
        spare = np.setdiff1d(np.arange(k), held)
        c[spare] = x[rng.choice(len(x), len(spare))]
    return c


class Index:
    """Coarse centroids and the codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, total: int, cell: int, code: int, seed: int):
        rng = np.random.default_rng(seed)
        cells = max(1, min(MOST_CELLS, round(total / cell), len(sample)))
        self.coarse = _k_means(sample, cells, 6, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]]
        self.cuts = [np.arange(len(rest[0]))[i::code] for i in range(min(code, rest.shape[1]))]
        some = rest[rng.permutation(len(rest))[:8000]]
        self.books = [_k_means(np.ascontiguousarray(some[:, c]), BOOK, 4, rng) for c in self.cuts]
        self.squares = [(b * b).sum(1) for b in self.books]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[cell]
        return np.stack([_nearest(np.ascontiguousarray(rest[:, c]), b, 1)[:, 0] for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the query's residual to each codebook entry: (sub-quantiser, query, entry)."""
        rest = q - self.coarse[cell]
        out = np.empty((len(self.cuts), len(q), BOOK), np.float32)
        for i, (c, b, bb) in enumerate(zip(self.cuts, self.books, self.squares)):
            r = rest[:, c]
            np.subtract((r * r).sum(1)[:, None] + bb, 2 * r @ b.T, out=out[i, :, : len(b)])
        return out


def usable(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(key, v) of vectors with `dimension` finite values, not all zero, as `_pack` has them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            with np.errstate(over="ignore"):
                x = np.array([np.asarray(v, np.float64) for v in b["v"]]).astype(np.float32) + np.float32(0)  # no negative zeros
            good = np.isfinite(x).all(1) & x.any(1)
            yield pd.DataFrame({"key": b["key"][good], "v": [_pack(v) for v in x[good]]})

    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dimension)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"))
    return spread(rows, "key").mapInPandas(pack, "key bigint, v binary")


def _pack(vector: np.ndarray) -> bytes:
    """A vector's bytes: two for each value where that loses nothing, else four."""
    with np.errstate(over="ignore"):
        half = vector.astype(np.float16)
    return (half if np.array_equal(half.astype(np.float32), vector) else vector).tobytes()


def _matrix(column: pd.Series, dimension: int) -> np.ndarray:
    if all(len(b) == 2 * dimension for b in column):
        return np.frombuffer(b"".join(column), np.float16).reshape(-1, dimension).astype(np.float32)
    return np.stack([np.frombuffer(b, np.float16 if len(b) == 2 * dimension else np.float32).astype(np.float32, copy=False) for b in column])


def nearest_vectors(
    df: DataFrame, key: str, vector: str, k: int = 5, dimension: int = 384, probes: int = PROBES, shortlist: int = SHORTLIST, cell: int = CELL, block: int = BLOCK, fit_sample: int = FIT_SAMPLE, seed: int = 11, ask_every: int = 1
) -> DataFrame:
    """(key, neighbour, distance, rank): for every usable vector its `k` nearest others by Euclidean distance.

    With `ask_every` only keys divisible by it are asked for, against all vectors. Equal distances are ranked by the smaller key. Null, short, long, all-zero and non-finite vectors take no part; repeated
    keys with the same vector count once; with fewer than k + 1 vectors there are fewer neighbours. Distances are exact;
    which neighbours are found depends on `probes` and `shortlist`.
    """
    spark = df.sparkSession

    packed = usable(df, key, vector, dimension)
    packed = materialise(packed.withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))), "vectors")
    # Equal vectors are one class, told by 128 bits of hash and combined before the shuffle; the vectors themselves travel once.
    classes = materialise(packed.groupBy("same").agg(F.min("key").alias("rep"), F.count_distinct("key").alias("copies"), F.count("*").alias("n")), "classes")
    members = materialise(join_classes(packed.select("same", "key").distinct(), classes.select("same", "rep", "n"), ["same"], "n", packed.count()).select("key", "rep"), "members")
    one_each = packed.join(classes.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"]).select("key", "v")
    total = one_each.count()
    if total == 0:
        return spark.createDataFrame([], "key bigint, neighbour bigint, distance double, rank int")
    # a bounded sample: a hash of the key decides, and the bound holds whatever the table's size
    share = min(1.0, fit_sample / total)
    picked = one_each.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("key", "v").limit(fit_sample).toPandas()
    if not len(picked):
        picked = one_each.select("key", "v").limit(fit_sample).toPandas()
    picked = picked.sort_values("key")
    index = spark.sparkContext.broadcast(Index(_matrix(picked["v"], dimension), total, cell, CODE, seed))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"], dimension)
            near = _nearest(x, index.value.coarse, probes)
            code = index.value.encode(x, near[:, 0])
            yield pd.DataFrame({"key": b["key"], "v": b["v"], "code": [c.tobytes() for c in code], "near": list(near)})

    assigned = materialise(one_each.mapInPandas(assign, "key bigint, v binary, code binary, near array<int>"), "assigned")
    # blocks of large cells, and lots of the queries of popular ones, each of which gets the block; a row a cell, MOST_CELLS at most
    asked = members.where(F.col("key") % ask_every == 0)
    asking = assigned.join(asked.select(F.col("rep").alias("key")).distinct(), "key", "left_semi") if ask_every > 1 else assigned
    of_cell = assigned.groupBy(F.element_at("near", 1).alias("cell")).agg(F.count("*").alias("n"))
    askers = asking.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.count("*").alias("asks"))
    held = of_cell.join(askers, "cell", "left").select("cell", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"), F.ceil(F.coalesce("asks", F.lit(0)) / F.lit(4 * block)).cast("int").alias("lots"))
    held = F.broadcast(materialise(held, "cells"))
    stored = assigned.select(F.element_at("near", 1).alias("cell"), "key", "v", "code").join(held.where("lots > 0"), "cell")
    stored = stored.select("cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "key", "v", "code", F.lit(0).alias("probe"))
    visits = asking.select(F.posexplode("near").alias("probe", "cell"), "key", "v").join(held, "cell")
    visits = visits.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("lots")).cast("int").alias("lot"), "key", "v", F.lit(None).cast("binary").alias("code"), (F.col("probe") + 1).alias("probe"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        probe = group["probe"].to_numpy()
        mine, base = group[probe > 0], group[probe == 0]
        if not len(base) or not len(mine):
            return pd.DataFrame({"key": [], "rep": [], "d2": []})
        x, ids = _matrix(base["v"], dimension), base["key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        codes = np.ascontiguousarray(np.frombuffer(b"".join(base["code"]), np.uint8).reshape(len(ids), -1)[order].T)
        asking_ids, out = mine["key"].to_numpy(), []
        q_all, xx = _matrix(mine["v"], dimension), (x * x).sum(1)
        most, kept = min(shortlist, len(ids)), min(k, len(ids))
        for at in range(0, len(q_all), 64):
            q, q_ids = q_all[at : at + 64], asking_ids[at : at + 64]
            t = index.value.tables(q, int(group["cell"].iat[0]))
            rough = np.zeros((len(q), len(ids)), np.float32)
            for of_part, code in zip(t, codes):
                rough += of_part.take(code, axis=1)
            self_ = ids == q_ids[:, None]
            rough[self_] = np.inf
            # the shortlist by single precision, and what is that near to its k best exactly
            near = np.where(rough <= np.partition(rough, most - 1, axis=1)[:, most - 1 : most], xx - 2 * (q @ x.T), np.inf)
            near[self_] = np.inf
            edge = np.partition(near, kept - 1, axis=1)[:, kept - 1] + _SLACK * (1 + (q * q).sum(1))
            take = min(len(ids), max(kept, int((near <= edge[:, None]).sum(1).max())))
            best = np.sort(np.argpartition(near, take - 1, axis=1)[:, :take], axis=1)
            d2, lot = np.empty(best.shape), max(1, _EXACT // take)
            for b in range(0, len(q), lot):
                diff = x[best[b : b + lot]].astype(np.float64) - q[b : b + lot, None, :]
                d2[b : b + lot] = np.einsum("ijk,ijk->ij", diff, diff)
            d2[np.isinf(np.take_along_axis(near, best, 1))] = np.inf
            top = np.argsort(d2, axis=1, kind="stable")[:, :kept]
            d2 = np.take_along_axis(d2, top, 1)
            found = ids[np.take_along_axis(best, top, 1)]
            good = np.isfinite(d2)
            out.append(pd.DataFrame({"key": np.repeat(q_ids, kept)[good.ravel()], "rep": found[good], "d2": d2[good]}))
        return pd.concat(out)

    near = stored.unionByName(visits).groupBy("cell", "part", "lot").applyInPandas(search, "key bigint, rep bigint, d2 double")
    # the k nearest classes of each class, over all its cells; a class is among them once
    best = Window.partitionBy("key").orderBy("d2", "rep")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("key", "rep", "d2")
    near = materialise(near, "near")
    # Of equal vectors only the k + 1 smallest keys can be among anybody's nearest; each task keeps its own before the shuffle.
    first = Window.partitionBy("rep").orderBy("key")
    smallest = materialise(members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("rep", F.col("key").alias("neighbour")), "smallest")
    own = classes.where("copies > 1").select(F.col("rep").alias("key"), "rep", F.lit(0.0).alias("d2"))
    # Ranked once per class, with one neighbour more than k: a member that finds itself there leaves it out.
    listed = near.unionAll(own).join(smallest, "rep")
    ranked = listed.select("key", "neighbour", "d2").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("d2", "neighbour"))).where(F.col("n") <= k + 1)
    lists = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "d2"))).alias("list"))  # k + 1 entries at most
    each = asked.join(lists.withColumnRenamed("key", "rep"), "rep").select("key", F.slice(F.filter("list", lambda e: e["neighbour"] != F.col("key")), 1, k).alias("list"))
    return each.select("key", F.posexplode("list").alias("rank", "e")).select("key", F.col("e.neighbour").alias("neighbour"), F.sqrt("e.d2").alias("distance"), (F.col("rank") + 1).alias("rank"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = nearest_vectors(read(spark, root, "content_vec"), "vec_rowid", "embedding")
    return found.select(F.least("key", "neighbour").alias("vec_rowid_a"), F.greatest("key", "neighbour").alias("vec_rowid_b")).distinct()


def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The searches of the stated query set: every vector whose id is divisible by 20, against all."""
    found = nearest_vectors(read(spark, root, "content_vec"), "vec_rowid", "embedding", ask_every=20)
    return found.select(F.col("key").alias("vec_rowid"), F.col("neighbour").alias("neighbour_rowid"), "rank", F.round("distance", 6).alias("distance"))


P3_FOUND_SQL = """
WITH v AS (SELECT DISTINCT vec_rowid AS k, embedding::DOUBLE[] AS e FROM content_vec WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
  d AS (SELECT a.k, b.k AS n, row_number() OVER (PARTITION BY a.k ORDER BY list_distance(a.e, b.e), b.k) AS rank FROM v a JOIN v b ON a.k <> b.k)
SELECT DISTINCT least(k, n) AS vec_rowid_a, greatest(k, n) AS vec_rowid_b FROM d WHERE rank <= 5
"""

P3_NEIGHBOURS_SQL = """
WITH v AS (SELECT DISTINCT vec_rowid AS k, embedding::DOUBLE[] AS e FROM content_vec WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
  d AS (SELECT a.k, b.k AS n, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.k ORDER BY list_distance(a.e, b.e), b.k)::INT AS rank FROM v a JOIN v b ON a.k <> b.k WHERE a.k % 20 = 0)
SELECT k AS vec_rowid, n AS neighbour_rowid, rank, round(d, 6) AS distance FROM d WHERE rank <= 5
"""
