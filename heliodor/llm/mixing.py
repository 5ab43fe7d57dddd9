"""Problem 9: sources mixed to target weights, by temperature and budgeted block permutations.

Weights follow w_i(a) ~ p_i * (t_i / p_i)^a between the natural token shares p (a = 0) and the targets t (a = 1). For a budget of
tokens the exponent nearest to 1 within every source's repetition limit is found by bisection; without a budget the size is the
largest at which the targets themselves (a = 1) can be met. With a target entropy instead, the weights are w_i(a) ~ p_i^a at the
exponent, found by bisection, whose entropy it is: shares flatter or steeper than the natural ones. A source that gives w_i * budget tokens is repeated in whole epochs,
and a last part: a permutation of its documents by hash, cut into blocks whose token sums tell in which block the budget ends, so that
only that block is ranked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from heliodor.session import materialise
from heliodor.sources.tables import read

#: Documents of a permutation block on average.
BLOCK = 2_000


def temperature_weights(shares: dict[str, float], exponent: float, towards: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised shares raised to `exponent`; with `towards`, the path from the shares (0) to those targets (1)."""
    positive = {s: p for s, p in shares.items() if p > 0 and (towards is None or towards.get(s, 0) > 0)}
    raw = {s: p**exponent if towards is None else p * (towards[s] / p) ** exponent for s, p in positive.items()}
    total = sum(raw.values())
    return {s: raw.get(s, 0.0) / total if total else 0.0 for s in shares}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(good, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The largest exponent in [low, high] that is `good`, if good ones lie below; `low` if none is."""
    if good(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def nearest_exponent(good, centre: float = 1.0, high: float = 4.0, steps: int = 64, rounds: int = 60) -> float:
    """The `good` exponent in [0, high] that is nearest to `centre`: a grid around it, then bisection; `centre` if none is good.

    Both sides are tried, as a source that is scarce for the budget may need more of the temperature or less.
    """
    if good(centre):
        return centre
    step = max(centre, high - centre) / steps
    for k in range(1, steps + 1):
        for side in (-step, step):
            if 0 <= centre + k * side <= high and good(centre + k * side):
                bad, found = centre + (k - 1) * side, centre + k * side
                for _ in range(rounds):
                    middle = (bad + found) / 2
                    bad, found = (bad, middle) if good(middle) else (middle, found)
                return found
    return centre


def exponent_for_entropy(shares: dict[str, float], target: float) -> float:
    """The exponent at which the tempered shares have the entropy `target`; falling in the exponent between 0 (uniform) and 8."""
    return bisect_exponent(lambda a: entropy(temperature_weights(shares, a)) >= target, 0.0, 8.0)


def settle(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, target_entropy: float | None = None) -> tuple[float, dict[str, tuple[float, float]]]:
    """(exponent, {source: (weight, tokens to give)}).

    `targets`: (share, most repeats). A source with no tokens gives none, and the others keep their proportions. With
    `target_entropy` the target shares only say which sources take part. A mixture is never larger than its limits allow.
    """
    have = {s: tokens.get(s, 0) for s in targets}
    total = sum(have.values())
    wanted = {s: t for s, (t, _) in targets.items()}
    if not total or not any(have[s] and wanted[s] > 0 for s in targets):
        return 1.0, {s: (0.0, 0.0) for s in targets}
    shares = {s: n / total for s, n in have.items()}
    room = {s: have[s] * max(0, targets[s][1] or 0) for s in targets}

    def fits(weights: dict[str, float]) -> bool:
        return all(weights[s] * budget <= room[s] * (1 + 1e-12) for s in targets)

    if target_entropy is not None:
        taking = {s: p if wanted[s] > 0 else 0.0 for s, p in shares.items()}
        exponent = exponent_for_entropy(taking, target_entropy)
        weights = temperature_weights(taking, exponent)
    else:
        exponent = 1.0 if budget is None else nearest_exponent(lambda a: fits(temperature_weights(shares, a, wanted)))
        weights = temperature_weights(shares, exponent, wanted)
    size = min(room[s] / w for s, w in weights.items() if w > 0)
    return exponent, {s: (w, w * (size if budget is None else min(budget, size))) for s, w in weights.items()}


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, target_entropy: float | None = None) -> dict[str, tuple[float, float]]:
    """(weight, tokens to give) of each target source; see `settle`."""
    return settle(tokens, targets, budget, target_entropy)[1]


def source_of(source: Column, names: list[str]) -> Column:
    """The target source that `source` spells: case, spaces and marks aside, with one letter more, less or wrong; else null."""
    bare = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    out = None
    for distance in (0, 1):
        for name in sorted(names):
            squashed = "".join(c for c in name.lower() if c.isalnum())
            at = F.levenshtein(bare, F.lit(squashed)) <= distance
            out = F.when(at, F.lit(name)) if out is None else out.when(at, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, budget: float | None = None, entropy_of: dict[str, float] | str | None = None, seed: int = 17, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(rows, report).

    rows: (key, source, epoch, tokens, shuffle_key), a document once for each epoch it is in; sorting by `shuffle_key` shuffles the mixture.
    report: (source, target_share, max_repeats, available_tokens, exponent, planned_share, tokens, share, repeats), a row a target.

    `budget`: the size as a multiple of the tokens that the target sources have. `entropy_of`: shares whose entropy the mixture gets, or
    'targets' for the target shares. `targets`: (source, target_share, max_repeats), a small table that is read on the driver. Documents of no target source, with a null
    key, or without tokens give no rows. Shares are reached up to one document a source. Repeated rows count as often as they occur.
    """
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source IS NOT NULL").collect()}
    named = docs.withColumn("__source", source_of(F.col(source), list(wanted))).where("__source IS NOT NULL")
    counted = count_tokens(named.select(key, text, F.col("__source").alias("src")), key, text, ("src",), folder, vocabulary).where("tokens > 0")
    counted = materialise(counted, "mix-counts")
    sums = {r["src"]: (r["tokens"], r["n"]) for r in counted.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # a row a target at most
    goal = {s: t for s, (t, _) in wanted.items()} if entropy_of == "targets" else entropy_of
    all_tokens = sum(t for t, _ in sums.values())
    exponent, given = settle({s: t for s, (t, _) in sums.items()}, wanted, None if budget is None else budget * all_tokens, None if goal is None else entropy(goal))
    spark = docs.sparkSession
    budgets = [(s, int(give // sums[s][0]), float(give - (give // sums[s][0]) * sums[s][0]), max(1, round(sums[s][1] / BLOCK))) for s, (_, give) in given.items() if s in sums and give > 0]
    per_source = {s: (e, r, b) for s, e, r, b in budgets}

    def by_source(at: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for s, values in per_source.items():
            out = F.when(F.col("src") == s, F.lit(values[at]).cast(kind)).otherwise(out)
        return out

    rows = counted.withColumn("epochs", by_source(0, "int")).withColumn("rest", by_source(1, "double")).withColumn("blocks", by_source(2, "int")).where("epochs IS NOT NULL")
    # whole epochs: no shuffle
    whole = rows.where("epochs > 0").select("key", "src", "tokens", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"))
    # the part epoch: blocks in hash order, cut where the budget ends
    part = rows.withColumn("h", F.xxhash64("key", F.lit(seed), F.col("epochs"))).withColumn("block", F.pmod(F.shiftrightunsigned("h", 20), F.col("blocks").cast("bigint")))
    ends = part.groupBy("src", "block").agg(F.sum("tokens").alias("in_block"))
    before = ends.withColumn("before", F.sum("in_block").over(Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
    placed = part.join(before, ["src", "block"]).where("before < rest")
    inside = placed.where("before + in_block <= rest")
    at_end = placed.where("before + in_block > rest").withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("src", "block").orderBy("h", "key", "tokens").rowsBetween(Window.unboundedPreceding, 0)))
    at_end = at_end.where(F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).where((F.col("upto") <= F.col("rest")) | (F.col("epochs") < by_repeats(wanted)))
    last = inside.select("key", "src", "tokens", (F.col("epochs") + 1).alias("epoch")).unionAll(at_end.select("key", "src", "tokens", (F.col("epochs") + 1).alias("epoch")))
    mixed = whole.unionAll(last).select("key", F.col("src").alias("source"), "epoch", "tokens", F.xxhash64("key", "epoch", F.lit(seed + 1)).alias("shuffle_key"))
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    facts = [(s, float(t), int(r), int(sums.get(s, (0, 0))[0]), float(exponent), float(given[s][0])) for s, (t, r) in wanted.items()]
    report = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, available_tokens bigint, exponent double, planned_share double").join(reached, "source", "left").na.fill(0, ["tokens"])
    report = report.withColumn("share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))).withColumn("repeats", F.when(F.col("available_tokens") > 0, F.col("tokens") / F.col("available_tokens")))  # a row a target
    return mixed, report


def by_repeats(wanted: dict[str, tuple[float, int]]) -> Column:
    """The repetition limit of the row's source."""
    out = F.lit(0)
    for s, (_, repeats) in wanted.items():
        out = F.when(F.col("src") == s, F.lit(repeats)).otherwise(out)
    return out


#: Tokens of the mixture under a budget, as a multiple of those at hand: more than the targets allow within the limits.
BUDGET = 1.25


def _project(spark: SparkSession, root: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix(read(spark, root, "documents").select("doc_id", "text", "source"), read(spark, root, "mix_targets"), "doc_id", "text", "source", **how)


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The largest mixture that meets the target shares."""
    return _project(spark, root)[0].withColumnRenamed("key", "doc_id")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return _project(spark, root)[1]


def p9_budget_report(spark: SparkSession, root: str) -> DataFrame:
    """A mixture of BUDGET times the tokens at hand, as near to the targets as the repetition limits allow: the exponent is bisected."""
    return _project(spark, root, budget=BUDGET)[1]


def p9_entropy_report(spark: SparkSession, root: str) -> DataFrame:
    """The natural shares tempered to the entropy of the targets: the exponent is bisected."""
    return _project(spark, root, entropy_of="targets")[1]
