"""Keyword search with BM25, vector search, and their fusion.

The inverted index is an ordinary table of token occurrences. Stored, it is laid out in the order of its terms, so that a query reads the
parts whose range holds its terms. It is filtered by term before anything is shuffled, so only the matching occurrences travel.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.session import materialise, spread
from heliodor.sources.tables import read

COLUMNS = ("title", "body", "type", "platforms")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF = 60


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they fold to."""
    marked = {}
    for code in [*range(0xC0, 0x180), *range(0x1CD, 0x220), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        plain = unicodedata.normalize("NFD", c)
        if len(plain) > 1 and plain[0].isascii() and plain[0].isalpha() and c.lower() == c:
            marked[c] = plain[0].lower()
    return "".join(marked), "".join(marked.values())


FOLD_FROM, FOLD_TO = _fold_table()
TOKEN = r"([\p{L}\p{N}]+)"


def folded(text: Column) -> Column:
    """Lower case, without the marks of Latin letters; '' for null. A text of single-byte characters has no marks to look up."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Runs of letters and numbers of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(1))


def tokenize(text: str) -> list[str]:
    """The same on the driver, for queries."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)))


class Term(NamedTuple):
    tokens: tuple[str, ...]
    prefix: bool


class QuerySyntaxError(ValueError):
    pass


def compile_query(query: str, strict: bool = False) -> list[Term]:
    """The terms of a query; any of them may match.

    Quoted parts are phrases and come first; what is left is cut at white space, and words of three or more characters match as
    prefixes. A word with other marks is a phrase of its tokens. Operators have no meaning. `strict` refuses words with marks.
    """
    phrases = re.findall(r'"([^"]+)"', query)
    words = [w.lower() for w in re.sub(r'"[^"]+"', "", query).split()]
    out = [Term(tuple(t), False) for p in phrases if (t := tokenize(p))]
    for word in words:
        starred = word.endswith("*")
        if strict and not re.fullmatch(r"[^\W]+\*?", word):
            raise QuerySyntaxError(word)
        if t := tokenize(word):
            out.append(Term(tuple(t), starred or len(word) >= 3 and not word.startswith("-") and "*" not in word and '"' not in word))
    return out


def occurrences(content: DataFrame) -> DataFrame:
    """The inverted index: (rowid, col, pos, term), a row for each token."""
    each = [F.struct(F.lit(i).alias("col"), tokens(F.col(c)).alias("t")) for i, c in enumerate(COLUMNS)]
    return content.select(F.col("content_rowid").alias("rowid"), F.explode(F.array(*each)).alias("c")).select("rowid", "c.col", F.posexplode("c.t").alias("pos", "term"))


def lengths(content: DataFrame) -> DataFrame:
    """(rowid, dl): tokens of each row over all searched columns."""
    return content.select(F.col("content_rowid").alias("rowid"), reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in COLUMNS]).alias("dl"))


class Stored(NamedTuple):
    """A stored index: `occurrences` in the order of terms, and `lengths`."""

    occurrences: DataFrame
    lengths: DataFrame


def store_index(content: DataFrame, keep: bool = False) -> Stored:
    """Write the index of `content` once; with `keep` it outlives a `scratch` block. Ranges of (term, row) are the files, so a frequent term is spread over several."""
    texts = spread(content.select("content_rowid", *COLUMNS), "content_rowid")
    ordered = occurrences(texts).repartitionByRange("term", "rowid").sortWithinPartitions("term", "rowid", "col", "pos")
    return Stored(materialise(ordered, "index", keep), materialise(lengths(texts), "lengths", keep))


_stored: dict[tuple, Stored] = {}


def index_of(spark: SparkSession, root: str) -> Stored:
    """The stored index of the table `content` under `root`, built when it is first asked for in this application and whenever the
    table's files have changed since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/content.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, seen = system.listFiles(path, True), []
    while files.hasNext():
        one = files.next()
        seen.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(sorted(seen)))
    if key not in _stored:
        _stored[key] = store_index(read(spark, root, "content"), keep=True)
    return _stored[key]


def postings(index: DataFrame) -> DataFrame:
    """(term, rowid, tf)."""
    return index.groupBy("term", "rowid").agg(F.count("*").alias("tf"))


def _hits(index: DataFrame, terms: list[Term]) -> DataFrame:
    """(rowid, term_no, f): how often each query term occurs in each row. A phrase lies in one column."""
    slots = []
    for j, term in enumerate(terms):
        for k, token in enumerate(term.tokens):
            last = k == len(term.tokens) - 1
            match = F.col("term").startswith(token) if term.prefix and last else F.col("term") == token
            slots.append((match, F.when(match, F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")))))
    found = index.where(reduce(lambda a, b: a | b, [m for m, _ in slots]))
    each = found.select("rowid", "col", "pos", F.explode(F.array_compact(F.array(*[s for _, s in slots]))).alias("s"))
    sizes = reduce(lambda out, j: F.when(F.col("j") == j, len(terms[j].tokens)).otherwise(out), range(len(terms)), F.lit(0))
    begun = each.groupBy("rowid", F.col("s.j").alias("j"), "col", (F.col("pos") - F.col("s.k")).alias("start")).agg(F.count_distinct("s.k").alias("n"))
    return begun.where(F.col("n") == sizes).groupBy("rowid", F.col("j").alias("term_no")).agg(F.count("*").alias("f"))


def bm25(content: DataFrame, terms: list[Term], index: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(rowid, score) of the rows with any term, higher is better. No terms: no rows.

    `index` and `sizes` are stored results of `occurrences` and `lengths`; without them the texts are read once for each. What
    a query needs of them, the hits and the lengths, is small and written once, as the statistics and the scores both read it.
    """
    if not terms:
        return content.select(F.col("content_rowid").alias("rowid"), F.lit(0.0).alias("score")).where(F.lit(False))
    texts = spread(content.select("content_rowid", *COLUMNS), "content_rowid")
    hits = materialise(_hits(occurrences(texts) if index is None else index, terms), "hits")
    size = materialise(lengths(texts), "lengths") if sizes is None else sizes
    corpus = size.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avg")).alias("c")).scalar()
    rows_with = hits.groupBy("term_no").agg(F.count("*").alias("df"))  # a row a query term
    scored = hits.join(rows_with, "term_no").join(size, "rowid").withColumn("c", corpus)
    idf = F.log((F.col("c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("c.avg")))
    return scored.groupBy("rowid").agg(F.round(F.sum(part), 12).alias("score"))  # so that equal scores tie whatever the order of summing


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbered in order. `rows` are the few of a top-k, so one partition holds them."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def keyword_search(content: DataFrame, query: str, limit: int = 20, type_: str | None = None, index: DataFrame | None = None, strict: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(rowid, score, fts_rank): the 2 * limit best rows; ties go to the smaller rowid. A type is filtered before the cut."""
    rows = bm25(content, compile_query(query, strict), index, sizes)
    if type_:
        rows = rows.join(content.where(F.col("type") == type_).select(F.col("content_rowid").alias("rowid")), "rowid", "left_semi")
    return _ranked(rows.orderBy(F.desc("score"), "rowid").limit(2 * limit), [F.desc("score"), F.col("rowid")], "fts_rank")


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of a vector column to a constant vector, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * F.lit(math.sqrt(sum(x * x for x in query)))
    return 1 - total(F.zip_with(v, q, lambda a, b: a * b)) / F.nullif(norm, F.lit(0.0))


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(vec_rowid, distance) of the k nearest vectors of the query's length, by exact distance; ties go to the smaller id."""
    rows = vectors.where(F.size("embedding") == len(query)).select("vec_rowid", distance(F.col("embedding"), query, metric).alias("distance"))
    return rows.where("distance IS NOT NULL").orderBy("distance", "vec_rowid").limit(k)


def semantic_search(content: DataFrame, vectors: DataFrame, mapping: DataFrame, query: list[float], limit: int = 20, type_: str | None = None, prefilter: bool = False) -> DataFrame:
    """(rowid, distance, vec_rank): the 2 * limit best of the 4 * limit nearest vectors' rows.

    A type is filtered after the search for neighbours, so a rare one can come back short; `prefilter` filters before.
    Vectors of rows that are gone are dropped, and repeated map rows count once.
    """
    kept = content.where(F.col("type") == type_) if type_ else content
    rows = kept.select(F.col("content_rowid"))
    if prefilter and type_:
        mine = mapping.join(rows, "content_rowid", "left_semi").select("vec_rowid")
        vectors = vectors.join(mine, "vec_rowid", "left_semi")
    near = knn(vectors, query, 4 * limit)
    held = mapping.distinct().join(near, "vec_rowid").join(rows, "content_rowid").select(F.col("content_rowid").alias("rowid"), "distance")
    held = held.groupBy("rowid").agg(F.min("distance").alias("distance"))
    return _ranked(held.orderBy("distance", "rowid").limit(2 * limit), [F.col("distance"), F.col("rowid")], "vec_rank")


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion; ties keep keyword hits first, in their order."""
    both = keyword.select("rowid", "fts_rank").join(semantic.select("rowid", "vec_rank"), "rowid", "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("fts_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("vec_rank")), F.lit(0.0))
    return both.withColumn("score", score).orderBy(F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank")).limit(limit)


def hybrid_search(
    content: DataFrame, vectors: DataFrame, mapping: DataFrame, query: str, query_vector: list[float] | None, limit: int = 20, type_: str | None = None,
    keyword_only: bool = False, semantic_only: bool = False, index: DataFrame | None = None, by_document: bool = False, sizes: DataFrame | None = None,
) -> DataFrame:
    """(rowid, id, title, type, url, snippet, score, fts_rank, vec_rank), the best `limit` rows, unordered.

    Both only-flags together run nothing. Hits are chunks; `by_document` keeps the best chunk of each item.
    Bodies are read once the hits are known.
    """
    none = content.select(F.col("content_rowid").alias("rowid")).where(F.lit(False))
    words = none.withColumn("score", F.lit(0.0)).withColumn("fts_rank", F.lit(0)) if semantic_only else keyword_search(content, query, limit, type_, index, sizes=sizes)
    near = none.withColumn("distance", F.lit(0.0)).withColumn("vec_rank", F.lit(0)) if keyword_only or query_vector is None else semantic_search(content, vectors, mapping, query_vector, limit, type_)
    if keyword_only and semantic_only:
        words = none.withColumn("score", F.lit(0.0)).withColumn("fts_rank", F.lit(0))
    hits = fuse(words, near, limit if not by_document else 4 * limit)
    rows = hits.join(content.select(F.col("content_rowid").alias("rowid"), "id", "title", "type", "url", "body"), "rowid")
    if by_document:
        best = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("score", -F.col("rowid"))).alias("r")).select("r.*")
        rows = best.orderBy(F.desc("score"), "rowid").limit(limit)
    terms = [list(t.tokens) + [t.prefix] for t in compile_query(query)]
    cut = F.when(F.col("fts_rank").isNotNull(), make_snippet(terms)("body")).otherwise(leading_snippet(F.col("body")))
    return rows.select("rowid", "id", "title", "type", "url", cut.alias("snippet"), "score", "fts_rank", "vec_rank")


def leading_snippet(body: Column, most: int = 200) -> Column:
    return F.concat(F.substring(body, 1, most), F.lit("..."))


def snippet(body: str, terms: list[Term], size: int = 32) -> str:
    """The best window of `size` tokens: most distinct terms, then most matches, then the first; an ellipsis marks a cut side.

    A single match is put in the middle, unless a sentence starts up to half a window before it: then the window starts there.
    """
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body or "")]
    if not spans:
        return body or ""
    words = [tokenize(body[a:b])[0] if tokenize(body[a:b]) else "" for a, b in spans]
    matches = []
    for j, term in enumerate(terms):
        n = len(term.tokens)
        for i in range(len(words) - n + 1):
            if all((words[i + k].startswith(t) if term.prefix and k == n - 1 else words[i + k] == t) for k, t in enumerate(term.tokens)):
                matches.append((i, i + n, j))
    matches.sort()
    start = 0
    if matches:
        best = None
        for i, _, _ in matches:
            inside = [m for m in matches if m[0] >= i and m[1] <= i + size]
            key = (len({m[2] for m in inside}), len(inside), -i)
            if best is None or key > best[0]:
                best = (key, inside)
        first, last = best[1][0][0], best[1][-1][1]
        start = max(0, first - (size - (last - first)) // 2)
        starts = [i for i in range(max(0, first - size // 2), first + 1) if i == 0 or re.search(r"[.:!?]\s*$", body[spans[i - 1][1] : spans[i][0]])]
        if starts and last - starts[-1] <= size:
            start = starts[-1]
        start = max(0, min(start, len(words) - size))
    end = min(len(words), start + size)
    left, right = (spans[start][0] if start else 0), (spans[end][0] if end < len(words) else len(body))
    return ("..." if start else "") + body[left:right].rstrip() + ("..." if end < len(words) else "")


def make_snippet(terms: list[list]):
    compiled = [Term(tuple(t[:-1]), t[-1]) for t in terms]

    @F.pandas_udf("string")
    def cut(body: pd.Series) -> pd.Series:
        return pd.Series([snippet(b, compiled) for b in body], dtype=object)

    return cut
