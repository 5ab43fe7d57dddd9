"""Problem 8: texts into containers of a fixed token capacity, by swap-based local search.

The items are spread over blocks by a hash; a block holds a bounded number of tokens and is packed on its own, which costs at most
about one underfull container a block. A first fit of the falling sizes is improved by moves and by exchanges of one for one and two
for one between any two underfull containers of the block, each of which raises the sum of squared fills, until the containers are as few
as their tokens allow or no such move or exchange into a container that is as full or fuller is left.

A text is whole unless it alone exceeds the capacity: then it is cut into full containers and a rest that is packed as an item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from heliodor.session import materialise
from heliodor.sources.tables import read

CAPACITY = 4_096
#: Tokens of a block, in capacities.
BLOCK = 400


def first_fit(sizes: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Containers of (size, item) by best fit of falling sizes."""
    bins: list[list[tuple[int, int]]] = []
    gaps: list[tuple[int, int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append((size, item))
        insort(gaps, (gap - size, b))
    return bins


def _improve(donor: list, partner: list, gap: int) -> int:
    """Make one exchange that moves the most size from `donor` into the gap of `partner`; the size moved. Both are sorted."""
    best, change = 0, None
    # move one
    at = bisect_right(donor, (gap, float("inf"))) - 1
    if at >= 0 and donor[at][0] > 0:
        best, change = donor[at][0], ((at,), None)
    # one for one, then two for one
    for k, (given, _) in enumerate(partner):
        at = bisect_right(donor, (given + gap, float("inf"))) - 1
        if at >= 0 and donor[at][0] - given > best:
            best, change = donor[at][0] - given, ((at,), k)
        low, high = 0, len(donor) - 1
        while low < high:
            both = donor[low][0] + donor[high][0]
            if both - given > gap:
                high -= 1
            else:
                if both - given > best:
                    best, change = both - given, ((low, high), k)
                low += 1
        if best == gap:
            break
    if not change:
        return 0
    taken, given = change
    moved = [donor[i] for i in taken]
    for i in sorted(taken, reverse=True):
        del donor[i]
    if given is not None:
        insort(donor, partner.pop(given))
    for item in moved:
        insort(partner, item)
    return best


def _given(partner: list) -> np.ndarray:
    """What a partner may give back in an exchange: nothing, or an item of one of its sizes."""
    return np.unique([0, *(s for s, _ in partner)])


def _taken(donor: list) -> np.ndarray:
    """What an exchange may take from a sorted donor: nothing, one item or two, as their sizes' sums in order."""
    sizes = np.array([s for s, _ in donor], dtype="int64")
    one = np.unique(sizes)
    low, high = np.triu_indices(len(one), 1)
    return np.unique(np.concatenate(([0], one, one[low] + one[high], 2 * sizes[1:][sizes[1:] == sizes[:-1]])))


def local_search(bins: list[list[tuple[int, int]]], capacity: int) -> list[list[tuple[int, int]]]:
    """Raise the sum of squared fills by exchanges between underfull containers, emptying the least filled ones first.

    Rounds over all containers go on until one changes nothing, or the least number of containers is reached. Every underfull container
    that is as full as the donor or fuller is a partner; which of them an exchange helps is asked of all their items in one search of
    the donor's sums. Each exchange goes to the partner, so the sum of squares grows by whole numbers and the search ends.
    """
    bins = [sorted(b) for b in bins if b]
    fills = [sum(s for s, _ in b) for b in bins]
    gives = [_given(b) for b in bins]
    least, held, changed = -(-sum(fills) // capacity), len(bins), True
    while changed and held > least:
        changed = False
        for donor in sorted(range(len(bins)), key=lambda i: (fills[i], i)):
            moved = True
            while moved and bins[donor] and fills[donor] < capacity:
                moved = False
                partners = sorted((i for i in range(len(bins)) if i != donor and fills[donor] <= fills[i] < capacity), key=lambda i: -fills[i])
                if not partners:
                    break
                given, lengths = np.concatenate([gives[p] for p in partners]), [len(gives[p]) for p in partners]
                owner = np.repeat(np.arange(len(partners)), lengths)
                room, ends, at = given + np.repeat([capacity - fills[p] for p in partners], lengths), np.cumsum(lengths), 0
                while at < len(given) and bins[donor]:
                    taken = _taken(bins[donor])
                    helps = taken[taken.searchsorted(room[at:], "right") - 1] > given[at:]
                    if not helps.any():
                        break
                    k = owner[at + helps.argmax()]
                    p, at = partners[k], ends[k]
                    size = _improve(bins[donor], bins[p], capacity - fills[p])
                    fills[p], fills[donor], moved, changed = fills[p] + size, fills[donor] - size, True, True
                    gives[p], gives[donor] = _given(bins[p]), _given(bins[donor])
                if not bins[donor]:
                    held -= 1
            if held <= least:
                break
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int, search: bool = True) -> list[int]:
    """The container of each item. Sizes are at most `capacity`."""
    out = [0] * len(sizes)
    bins = first_fit(sizes, capacity)
    for no, b in enumerate(local_search(bins, capacity) if search else bins):
        for _, item in b:
            out[item] = no
    return out


def fill_containers(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, block: int = BLOCK, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, search: bool = True) -> DataFrame:
    """(container, key, piece, first_token, tokens): where each text, or each piece of an oversized one, goes.

    Null keys are left out. A null or empty text has no tokens and needs no container: its row has a null container. Repeated
    rows are packed as often as they occur. An empty table gives no rows. No text takes more than its tokens' room. Without `search`
    the packing is that of best fit alone, which the search starts from.
    """
    counted = count_tokens(df, key, text, folder=folder, vocabulary=vocabulary)
    counted = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "token-counts")
    total = counted.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    blocks = max(1, round(total / (block * capacity)))
    cap = F.lit(capacity)
    full = F.when(F.col("tokens") > cap, F.floor(F.col("tokens") / cap)).otherwise(0).cast("int")
    pieces = counted.withColumn("full", full)
    # full pieces: a container each, numbered below zero by row and piece, without any shuffle
    whole = pieces.where("full > 0").select("key", "row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select(F.concat_ws("-", F.lit("full"), "key", "row", "piece").alias("container"), "key", "piece", (F.col("piece") * cap).cast("bigint").alias("first_token"), cap.cast("bigint").alias("tokens"))
    rest = pieces.select("key", "row", F.col("full").alias("piece"), (F.col("full") * cap).cast("bigint").alias("first_token"), (F.col("tokens") - F.col("full") * cap).alias("tokens"))
    nothing = counted.where("tokens = 0").select(F.lit(None).cast("string").alias("container"), "key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("tokens"))

    def one_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "piece", "tokens"], kind="stable")
        at = pack(group["tokens"].tolist(), capacity, search)
        name = f"{int(group['block'].iat[0])}-"
        return pd.DataFrame({"container": [name + str(c) for c in at], "key": group["key"], "piece": group["piece"], "first_token": group["first_token"], "tokens": group["tokens"]})

    spread = rest.where("tokens > 0").withColumn("block", F.pmod(F.xxhash64("key", "row"), F.lit(blocks)))
    packed = spread.groupBy("block").applyInPandas(one_block, "container string, key bigint, piece int, first_token bigint, tokens bigint")
    return whole.unionAll(packed).unionAll(nothing)


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return fill_containers(read(spark, root, "documents").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Containers before and after the search, tokens, share of room used, and the least number that could hold the tokens."""
    docs = read(spark, root, "documents").select("doc_id", "text")
    before = fill_containers(docs, "doc_id", "text", search=False).where("container IS NOT NULL").agg(F.count_distinct("container").alias("n"))
    fills = p8_containers(spark, root).where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    out = fills.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).withColumn("best_fit_containers", before.scalar())
    return out.select("best_fit_containers", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.lit(CAPACITY)).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.lit(CAPACITY))).alias("fill"))
