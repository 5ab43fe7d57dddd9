"""Problem 6: template residue, filler and error pages in place of content.

Character n-gram models of filler, of notices and of natural prose score a text. Windows whose likelihood ratio favours a residue
model are marked, and a unit (a sentence or a line) is residue when the marked windows cover it: a sentence that merely mentions an
error keeps its uncovered rest and isn't. Unfilled placeholders are matched by their syntax, empty-value words by the whole field.
Code, inline or fenced, is taken out first, as it shows such things as examples.

The residue models are trained on sentences drawn from the grammars of `residue_bank`. The prose model is the count of each of
their n-grams in all texts at hand, whole, less the stretches that consist of such n-grams alone; n-grams that the residue
models don't know can't speak for them and need no count, so the model's size is bounded by the bank's.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.residue_bank import DUMMY_WORDS, EMPTY_VALUES, FILLER, NOTICES, PLACEHOLDERS, PROSE
from heliodor.session import spread
from heliodor.sources.tables import read

#: Lengths of n-grams; sentences drawn from each wording; what an order that doesn't know an n-gram costs the lower one, in nats.
ORDERS, DRAWN, BACKOFF = (2, 3, 4, 5), 60, 0.7
#: Weight of the lower order in the prose model, as a number of characters.
PRIOR = 20.0
_BITS = 20
WINDOW, MARGIN, COVERAGE = 16, 0.4, 0.8
#: A unit is prose where fewer of its characters end a known n-gram of the highest order.
LEAST_KNOWN = 0.35
#: A stretch of so many characters of which this share ends n-grams of the bank isn't counted as prose.
STRETCH, KNOWN = 24, 0.9
_CHUNK = 250_000

_FENCE = re.compile(r"^(```+|~~~+)[^\n]*\n.*?^\1[ \t]*$", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]+`")
_PLACE = re.compile("|".join(PLACEHOLDERS))
_UNIT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|[。！？]|(?=\n)|$)", re.M)
#: Time marks and cue numbers of captured talks, and the layout of converted pages.
_MARKS = re.compile(r"^\s*\d+\s*$|\[?\(?\b\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\)?\]?(?:\s*-->\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?)?|^WEBVTT.*$", re.M)
_TIMED = re.compile(r"\d:\d\d|WEBVTT")
_LAYOUT = re.compile(r"^#.*$|^Source: .*$|^\s*[-*_=]{3,}\s*$", re.M)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Table slots of n-grams whose k-th characters are columns[k]."""
    h = np.zeros(len(columns[0]), np.uint32)
    for column in columns:
        h = (h ^ column) * np.uint32(2654435769)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(2246822519)) >> np.uint32(32 - _BITS)


def _slots(codes: np.ndarray, order: int) -> np.ndarray:
    """Table slots of all n-grams of `order` in a text."""
    n = len(codes) - order + 1
    return _hash([codes[k : k + n] for k in range(order)])


class NGrams:
    """Conditional character probabilities, interpolated over the orders with weights by the number of followers."""

    def __init__(self, texts: list[str]):
        self.counts: dict[str, Counter] = defaultdict(Counter)
        for text in texts:
            padded = "\n" * (max(ORDERS) - 1) + text.lower() + "\n"
            for i in range(max(ORDERS) - 1, len(padded)):
                for n in (1, *ORDERS):
                    self.counts[padded[i - n + 1 : i]][padded[i]] += 1
        self.totals = {h: sum(c.values()) for h, c in self.counts.items()}

    def p(self, gram: str) -> float:
        out = 1 / 4000
        for n in range(1, len(gram) + 1):
            h = gram[len(gram) - n : -1]
            if h not in self.totals:
                break
            followers = self.counts[h]
            out = (followers.get(gram[-1], 0) + len(followers) * out) / (self.totals[h] + len(followers))
        return out


def draw(wording: str, rng: random.Random) -> str:
    """A sentence of a wording: one part of each `{a|b}`, numbers and names for `<n>` and `<id>`."""
    while m := re.search(r"\{([^{}]*)\}", wording):
        wording = wording[: m.start()] + rng.choice(m.group(1).split("|")) + wording[m.end() :]
    wording = re.sub("<n>", lambda _: str(rng.randint(1, 90)), wording)
    return re.sub("<id>", lambda _: "".join(rng.choices("0123456789abcdef", k=rng.choice((4, 8, 12)))), wording)


def bank(families: dict[str, tuple[str, ...]], seed: int = 3, drawn: int = DRAWN) -> list[str]:
    """Sentences of all wordings, each wording with the same number; one that says less is repeated."""
    rng = random.Random(seed)
    return [draw(w, rng) for wordings in families.values() for w in wordings for _ in range(drawn)]


class Residue:
    """The models of filler and of notices, and the slots of the n-grams they know."""

    def __init__(self, filler: dict = FILLER, notices: dict = NOTICES, seed: int = 3):
        rng = random.Random(seed)
        dummy = ["Lorem ipsum " + " ".join(rng.choices(DUMMY_WORDS, k=18)) + "." for _ in range(120)]
        self.models = [NGrams(dummy + bank(filler, seed)), NGrams(bank(notices, seed))]
        self.grams: dict[int, list[str]] = {}
        self.at: dict[int, np.ndarray] = {}
        for n in (1, *ORDERS):
            self.grams[n] = sorted({h + c for m in self.models for h, cs in m.counts.items() if len(h) == n - 1 for c in cs})
            codes = _codes("".join(self.grams[n])).reshape(-1, n)
            self.at[n] = np.full(1 << _BITS, -1, np.int32)
            self.at[n][_hash([codes[:, k] for k in range(n)])] = np.arange(len(codes))

    def count(self, texts: list[str]) -> dict[int, np.ndarray]:
        """How often each known n-gram stands in the prose of `texts`; order 0 has the number of characters."""
        out = {n: np.zeros(len(g), np.int64) for n, g in self.grams.items()} | {0: np.zeros(1, np.int64)}
        pad = max(ORDERS) - 1
        between = "\n" * pad
        for at in range(0, len(texts), 200):
            units = between.join([t[a:b] for t in texts[at : at + 200] for a, b in _units(t)])
            codes = _codes(between + units.lower() + between)
            found = {n: self.at[n][_slots(codes[pad - n + 1 :], n)] for n in self.grams}
            known = found[pad + 1] >= 0
            sums = np.concatenate([[0], np.cumsum(known)])
            # residue itself: units, and stretches within units, that consist of the bank's n-grams
            breaks = codes[pad:] == 10
            starts = np.flatnonzero(~breaks & np.concatenate([[True], breaks[:-1]]))
            ends = np.flatnonzero(breaks & np.concatenate([[False], ~breaks[:-1]]))
            whole = known[ends] & (sums[ends] - sums[starts] >= KNOWN * (ends - starts))
            marks = np.zeros(len(known) + 1, np.int64)
            np.add.at(marks, starts[whole], 1)
            np.add.at(marks, ends[whole] + 1, -1)
            if len(known) > STRETCH:
                alike = np.flatnonzero(sums[STRETCH:] - sums[:-STRETCH] >= KNOWN * STRETCH)
                np.add.at(marks, alike, 1)
                np.add.at(marks, alike + STRETCH, -1)
            prose = np.cumsum(marks)[:-1] == 0
            for n, ids in found.items():
                out[n] += np.bincount(ids[(ids >= 0) & prose], minlength=len(out[n]))
            out[0] += int((prose & ~breaks).sum())
        return out

    def fit(self, counts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each order the log-likelihood ratios (filler, notice) of each slot, NaN where no model knows the n-gram; under 0, which slots the highest order knows."""
        built_in = self.count(list(PROSE))
        natural, lower = {}, {}
        for n, grams in self.grams.items():
            have = counts[n] + built_in[n]
            total = counts[0][0] + built_in[0][0]
            for i, g in enumerate(grams):
                history = natural.get(g[:-1], 0) if n > 1 else total
                natural[g] = int(have[i])
                lower[g] = (natural[g] + PRIOR * (lower[g[1:]] if n > 1 else 1 / 4000)) / (max(history, natural[g]) + PRIOR)
        tables = {}
        for n in ORDERS:
            table = np.full((1 << _BITS, 2), np.nan, np.float32)
            codes = _codes("".join(self.grams[n])).reshape(-1, n)
            table[_hash([codes[:, k] for k in range(n)])] = [[max(-4.0, min(4.0, math.log(m.p(g) / lower[g]))) for m in self.models] for g in self.grams[n]]
            tables[n] = table
        return tables | {0: ~np.isnan(tables[max(ORDERS)][:, 0])}


def fit(natural: list[str], residue: Residue | None = None) -> dict[int, np.ndarray]:
    """Ratio tables from texts in memory."""
    residue = residue or Residue()
    return residue.fit(residue.count(natural))


def _strip_code(text: str) -> str:
    if "`" in text or "~~~" in text:
        text = _INLINE.sub(" ", _FENCE.sub("\n", text))
    return text


def _units(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _UNIT.finditer(text):
        a, b = m.span()
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        label = b - a < 48 and (text[b - 1 : b] in (":", "—", "–") or a > 0 and text[a - 1 : a] + text[b - 1 : b] in ("[]", "()"))
        if b - a >= 8 and not label:  # who speaks is no content
            out.append((a, b))
    return out


def unit_scores(text: str, tables: dict[int, np.ndarray]) -> list[tuple[int, int, float, float]]:
    """(start, end, mean ratio, coverage) of each unit of `text` of which enough is known, under the residue model that suits it best."""
    units = _units(text)
    if not units:
        return []
    pad = max(ORDERS) - 1
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    between = "\n" * pad
    codes = _codes(between + between.join([lower[a:b] for a, b in units]) + "\n")
    sizes = np.array([b - a for a, b in units])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + pad)])
    held = np.concatenate([[0], np.cumsum(tables[0].take(_slots(codes, pad + 1)))])
    likely = np.flatnonzero(held[starts + sizes] - held[starts] >= LEAST_KNOWN * sizes)
    if not len(likely):
        return []
    if len(likely) < len(units):
        units = [units[i] for i in likely]
        codes = _codes(between + between.join([lower[a:b] for a, b in units]) + "\n")
    r = np.full((len(codes) - pad, 2), -1.0, np.float32)
    for n in ORDERS:
        known = tables[n].take(_slots(codes[pad - n + 1 :], n), axis=0)
        r -= BACKOFF
        np.copyto(r, known, where=~np.isnan(known))
    sizes = np.array([b - a for a, b in units])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + pad)])
    # the end of a line is part of a unit's score: a notice stands alone where a mention goes on
    ends = starts + sizes + np.array([text[b : b + 1] in ("", "\n") for _, b in units])
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(r, axis=0, dtype=np.float64)])
    mean = (sums[ends] - sums[starts]) / (ends - starts)[:, None]
    model = mean.argmax(1)
    mean = mean.max(1)
    coverage = np.where(mean > MARGIN, 1.0, 0.0)
    w = WINDOW
    long_ = ends - starts >= 2 * w
    for j in (0, 1):
        mine = np.flatnonzero(long_ & (model == j))
        if not len(mine):
            continue
        hot = np.concatenate([[0], np.cumsum((sums[w:, j] - sums[:-w, j]) / w > MARGIN)])
        at = np.arange(len(r))
        covered = hot[np.minimum(at + 1, len(hot) - 1)] > hot[np.clip(at - w + 1, 0, len(hot) - 1)]
        held = np.concatenate([[0], np.cumsum(covered)])
        coverage[mine] = (held[ends[mine]] - held[starts[mine]]) / (ends[mine] - starts[mine])
    return [(a, b, m, c) for (a, b), m, c in zip(units, mean.tolist(), coverage.tolist())]


def is_empty_value(text: str) -> bool:
    """Whether nothing but empty-value words is left besides time marks and layout."""
    seen = False
    for line in text.splitlines():
        rest = _MARKS.sub(" ", _LAYOUT.sub("", line)).strip().strip(".").strip().lower()
        if rest and rest not in EMPTY_VALUES and not all(w in EMPTY_VALUES for w in re.split(r"[\s,;|]+", rest)):
            return False
        seen = seen or bool(rest)
    return seen


def residue_reason(text: str | None, models: dict[int, np.ndarray]) -> str | None:
    """'placeholder', 'empty value', 'filler or notice', or None for a clean, null or blank text."""
    if not text or not text.strip():
        return None
    if is_empty_value(text):
        return "empty value"
    bare = _strip_code(text)
    if _TIMED.search(bare):
        bare = _MARKS.sub("\n", bare)
    if _PLACE.search(bare):
        return "placeholder"
    for at in range(0, len(bare), _CHUNK):
        part = bare[max(0, at - 200) : at + _CHUNK]
        for _, _, mean, coverage in unit_scores(part, models):
            if coverage >= COVERAGE and mean > MARGIN:
                return "filler or notice"
    return None


def find_residue(df: DataFrame, keys: str | tuple[str, ...], text: str, models) -> DataFrame:
    """(*keys, reason) of rows whose `text` is residue, wholly or in part. `models`: a broadcast of `fit`'s result.

    Rows with a null key, null and blank texts give no row; a repeated row is reported again; other columns are dropped.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*k, r) for *k, t in zip(*(b[n] for n in names), b["__text"]) if (r := residue_reason(t, models.value))]
            yield pd.DataFrame(found, columns=[*names, "reason"])

    rows = df.where(F.col(text).isNotNull()).dropna(subset=names).select(*names, F.col(text).alias("__text"))
    return spread(rows, *names).mapInPandas(judge, ", ".join([*fields, "reason string"]))


def count_prose(df: DataFrame, text: str, residue: Residue) -> dict[int, np.ndarray]:
    """`Residue.count` of all texts of `df`, whole; null texts have none. A task sends one sum for each known n-gram at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = shared.value, {}
        for b in batches:
            for n, c in known.count(b["text"].tolist()).items():
                sums[n] = sums[n] + c if n in sums else c
        for n, c in sums.items():
            ids = np.flatnonzero(c)
            yield pd.DataFrame({"n": n, "id": ids, "count": c[ids]})

    shared = df.sparkSession.sparkContext.broadcast(residue)
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    sums = rows.mapInPandas(count, "n int, id int, count bigint").groupBy("n", "id").agg(F.sum("count").alias("count")).toPandas()  # a row a known n-gram at most
    out = {n: np.zeros(len(g), np.int64) for n, g in residue.grams.items()} | {0: np.zeros(1, np.int64)}
    for n, part in sums.groupby("n"):
        out[int(n)][part["id"].to_numpy()] = part["count"].to_numpy()
    return out


def _fields(spark: SparkSession, root: str) -> list[DataFrame]:
    """The fields that are judged: (table_name, row_key, field, text)."""
    content = read(spark, root, "content").where(F.col("type").isin("doc", "sample", "talk")).select(F.lit("content").alias("table_name"), F.col("content_rowid").cast("string").alias("row_key"), F.lit("body").alias("field"), F.col("body").alias("text"))
    talks = read(spark, root, "wwdc_content")
    return [content, *(talks.select(F.lit("wwdc_content").alias("table_name"), F.col("id").alias("row_key"), F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("transcript", "description"))]


def project_models(spark: SparkSession, root: str):
    """A broadcast of the ratio tables, whose prose model counts all the fields that are judged."""
    residue, (content, transcript, description) = Residue(), _fields(spark, root)
    texts = content.select("text").unionAll(transcript.select("text")).unionAll(description.select("text"))
    return spark.sparkContext.broadcast(residue.fit(count_prose(texts, "text", residue)))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    models, (content, transcript, description) = project_models(spark, root), _fields(spark, root)
    rows = content.unionAll(transcript).unionAll(description)
    return find_residue(rows, ("table_name", "row_key", "field"), "text", models).drop("reason").distinct()
