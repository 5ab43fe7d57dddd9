"""Problem 10: the languages of documents and of stretches in mixed documents, by prediction by partial matching.

For each language a byte context tree of order 4 is fitted and frozen. The code length of a sentence under a language is exact:
a byte seen after its longest context costs its share there, a byte not seen pays the escape of that context and is coded with
the next shorter one. A document is cut into sentences of prose (of a code file its comments; headings, code, API names and
quotations left out) and each is given a language by the shortest code, where a change of language costs extra bits.

The trees are fitted on a bounded sample of labelled rows. As labels can be wrong, further fits use only the sentences that
the one before clearly gives the language of their label; a few built-in sentences stand in for languages without labelled rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.session import spread
from heliodor.sources.tables import read

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "zh")
#: Other ways a label names a language.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch"), "en": ("eng", "english"), "es": ("spa", "spanish", "español", "espanol", "castilian"), "fr": ("fra", "fre", "french", "français", "francais"),
    "it": ("ita", "italian", "italiano"), "ja": ("jpn", "jp", "japanese", "日本語"), "nl": ("nld", "dut", "dutch", "nederlands"), "pt": ("por", "portuguese", "português", "portugues"), "zh": ("zho", "chi", "cmn", "chinese", "中文", "mandarin"),
}
#: Sentences for a language that has no labelled rows.
SEEDS = {
    "de": "Das ist ein kurzer Text, der nicht viel sagt. Wenn sich die Ansicht ändert, wird sie neu gezeichnet. Bitte achten Sie darauf, dass alle Dateien vorhanden sind. Wir haben gesehen, wie man eine Methode verwendet und warum sie nützlich ist.",
    "en": "This is a short text that does not say much. When the view changes, it is drawn again. Please make sure that all of the files are there. We have seen how to use a method and why it is useful for your own application.",
    "es": "Este es un texto corto que no dice mucho. Cuando cambia la vista, se dibuja de nuevo. Asegúrese de que todos los archivos estén presentes. Hemos visto cómo se usa un método y por qué es útil para su propia aplicación.",
    "fr": "Ceci est un texte court qui ne dit pas grand-chose. Quand la vue change, elle est dessinée à nouveau. Vérifiez que tous les fichiers sont présents. Nous avons vu comment utiliser une méthode et pourquoi elle est utile pour votre application.",
    "it": "Questo è un testo breve che non dice molto. Quando la vista cambia, viene disegnata di nuovo. Assicurati che tutti i file siano presenti. Abbiamo visto come usare un metodo e perché è utile per la tua applicazione.",
    "ja": "これはあまり多くを語らない短い文章です。ビューが変わると、もう一度描画されます。すべてのファイルがあることを確認してください。メソッドの使い方と、それが役に立つ理由を見てきました。",
    "nl": "Dit is een korte tekst die niet veel zegt. Wanneer de weergave verandert, wordt deze opnieuw getekend. Zorg ervoor dat alle bestanden aanwezig zijn. We hebben gezien hoe u een methode gebruikt en waarom die nuttig is voor uw eigen toepassing.",
    "pt": "Este é um texto curto que não diz muito. Quando a vista muda, ela é desenhada novamente. Verifique se todos os arquivos estão presentes. Vimos como usar um método e por que ele é útil para a sua própria aplicação.",
    "zh": "这是一段没有说太多内容的短文。当视图发生变化时，它会重新绘制。请确保所有文件都存在。我们已经了解了如何使用一个方法，以及为什么它对您的应用程序有用。",
}

#: Bytes of context; labelled documents and characters of each that a language is fitted on; bits a change of language costs.
ORDER, FIT_DOCS, FIT_CHARS, SWITCH_BITS = 4, 200, 3_000, 14.0
#: Further fits, and the bits by which a sentence's label must beat the next language to be used in them.
ROUNDS, CLEAR_BITS = 3, 6.0
#: Consecutive sentences that make a language one of the document's.
RUN = 2
#: Documents that are judged together, and characters that are coded together.
_PART, _CHUNK = 10_000, 30_000
_PAD = b"\n" * (ORDER + 1)

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
_COMMENT = re.compile(r"^\s*(?://+!?|#+(?!\w)|--+|;+|\*+(?!/))\s?(.*)$")
_HEADING = re.compile(r"^\s{0,3}(?:\d{1,2}:\d\d(?::\d\d)?\s+)?#{1,6}\s")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_MARK = re.compile(r"^\s*[\[(]?\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?[\])]?\s*")
_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|»[^«»]*«|「[^「」]*」|『[^『』]*』|‹[^‹›]*›|‘[^‘’\n]{1,200}’(?!\w)|(?<!\w)\"[^\"\n]*\"(?!\w)|(?<!\w)'[^'\n]{2,200}'(?!\w)|`[^`\n]*`")
_QUOTE = re.compile(r"[“„«»「『‹‘\"'`]")
_TAG = re.compile(r"<br\s*/?>|</?(?:p|div|li|ul|ol|tr|td|h[1-6])\b[^<>]*>", re.I)
_OTHER_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_NAME = re.compile(r"https?://\S+|\b\w*[a-z][A-Z]\w*(?:\([^)\s]*\))?|\b[A-Z]{2,}\w*\b|\b\w*[\d_]\w*\b|\b\w+(?:\.\w+)+\b", re.A)
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])")
_CODE_LIKE = re.compile(r"[{};]\s*$|\s[-+*/%&|]?={1,3}\s|->|^\s*(?:[@.}\])]|#(?:include|import)|import \w+$|(?:let|var|func|struct|class|case|guard|return|switch|for|if|static|private|public)\b.*[)\]\w>({:]\s*$)|\w\(\S*\)\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_THREE_WORDS = re.compile(r"[^\W\d_]+(?:[\W\d_]+[^\W\d_]+){2}")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _comment_lines(code: str) -> Iterator[str]:
    block = False
    for line in code.split("\n"):
        if block:
            end = line.find("*/")
            yield re.sub(r"^\s*\*+(?!/)\s?", "", line if end < 0 else line[:end])
            block = end < 0
            if not block:
                yield ""
            continue
        at = line.lstrip()
        if at.startswith("/*"):
            end = at.find("*/", 2)
            yield re.sub(r"^\s*\*+\s?", "", at[2:] if end < 0 else at[2:end]).strip("* ")
            block = end < 0
            continue
        m = _COMMENT.match(line) if not re.match(r"\s*#(?:include|import|pragma|define|if|endif|else|undef)\b", line) else None
        if m:
            yield m.group(1)
        else:
            trailing = re.search(r"(?<![:\"'])//\s+(.{12,})$", line)
            yield trailing.group(1) if trailing else ""


def sentences(text: str | None, code: bool = False) -> list[str]:
    """The prose sentences of a document, in order, lower-cased and without names, quotations and marks.

    `code`: the whole text is code, so only its comments are prose. A fenced block inside another document is code and has
    no prose, its comments included. Null and empty texts have none.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\xa0", " ")
    if code:
        lines = list(_comment_lines(text))
    else:
        if "<" in text:
            text = _OTHER_TAG.sub(" ", _TAG.sub("\n", text))
        lines, fence = [], None
        for line in text.split("\n"):
            m = _FENCE.match(line)
            if m and (fence is None or line.strip().startswith(fence)):
                fence = m.group(1)[:3] if fence is None else None
                lines.append("")
            elif fence is None:
                lines.append("" if _HEADING.match(line) or line.lstrip().startswith((">", "|")) else line)
    units: list[str] = []
    open_unit = False
    for line in lines:
        line = _MARK.sub("", line) if line[:12].strip()[:1] in "0123456789[(" else line
        bullet = _BULLET.match(line)
        if bullet:
            line = line[bullet.end() :]
        part = line.strip()
        if not part or (not code and not part.endswith((".", "!", "?", "。", "！", "？")) and _CODE_LIKE.search(part)):
            open_unit = False
            continue
        if open_unit and not bullet:
            units[-1] += " " + part
        else:
            units.append(part)
        open_unit = not part.endswith((".", "!", "?", "…", "。", "！", "？", ":", "："))
    out = []
    for unit in units:
        if _QUOTE.search(unit):
            unit = _QUOTED.sub(" ", unit)
        for one in _END.split(unit):
            one = " ".join(_NAME.sub(" ", one).split()).lower()
            if _THREE_WORDS.search(one) or _WIDE.search(one) and sum(map(len, _LETTERS.findall(one))) >= 4:
                out.append(one)
    return out


class Models:
    """The frozen context trees of all languages over one table of byte strings of 1 to ORDER + 1 bytes."""

    def __init__(self, texts: dict[str, list[str]]):
        n_lang = len(LANGUAGES)
        data = [np.frombuffer(_PAD + _PAD.join(s.encode() for s in texts[lang]) + _PAD, np.uint8) for lang in LANGUAGES]
        self.keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for m in range(1, ORDER + 2):
            coded = [_grams(d, m)[ORDER + 1 - m :] for d in data]
            keys = np.unique(np.concatenate(coded))
            count = np.zeros((len(keys), n_lang), np.float64)
            for j, c in enumerate(coded):
                k, n = np.unique(c, return_counts=True)
                count[np.searchsorted(keys, k), j] = n
            self.keys.append(keys)
            counts.append(count)
        #: For each length m: cost of the last byte after the first m - 1, NaN where not seen; escape cost as a context.
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for m in range(1, ORDER + 2):
            keys, count = self.keys[m - 1], counts[m - 1]
            if m == 1:
                of = np.zeros(len(keys), np.int64)
                total, kinds = count.sum(0, keepdims=True), (count > 0).sum(0, keepdims=True)
            else:
                of = np.searchsorted(self.keys[m - 2], keys >> 8)
                size = len(self.keys[m - 2])
                total, kinds = np.zeros((size, n_lang)), np.zeros((size, n_lang))
                np.add.at(total, of, count)
                np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(count > 0, np.log2((total + kinds)[of] / count), np.nan)
                escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
            self.cost.append(np.vstack([cost, np.full((1, n_lang), np.nan)]).astype(np.float32))
            if m == 1:
                self.bottom = escape[0].astype(np.float32) + np.float32(8)
            else:
                self.escape.append(np.vstack([escape, np.zeros((1, n_lang))]).astype(np.float32))
        self._hash()

    def _hash(self) -> None:
        """Open-addressing tables of the keys, so that a look-up is a few steps on whole arrays."""
        self.tables = []
        for keys in self.keys:
            bits = max(4, int(math.ceil(math.log2(len(keys) + 1))) + 2)
            slot_key, slot_at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(keys), np.int32)
            left, steps = np.arange(len(keys)), 0
            where = _slot(keys, bits)
            while len(left):
                free = slot_key[where] < 0
                first = np.unique(np.where(free, where, -1 - np.arange(len(where))), return_index=True)[1]
                first = first[free[first]]
                slot_key[where[first]], slot_at[where[first]] = keys[left[first]], left[first]
                rest = np.ones(len(left), bool)
                rest[first] = False
                left, where, steps = left[rest], (where[rest] + 1) & ((1 << bits) - 1), steps + 1
            self.tables.append((bits, steps, slot_key, slot_at))

    def _find(self, m: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key among those of length m; one past the last where it wasn't seen."""
        bits, steps, slot_key, slot_at = self.tables[m - 1]
        at = _slot(keys, bits)
        out = np.where(slot_key[at] == keys, slot_at[at], len(self.keys[m - 1]))
        open_ = np.flatnonzero((slot_key[at] != keys) & (slot_key[at] >= 0))
        for _ in range(steps - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << bits) - 1)
            there = slot_key[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = slot_at[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def bits(self, units: list[str]) -> np.ndarray:
        """Code length of each unit under each language. Units that occur several times are coded once."""
        places = {u: i for i, u in enumerate(dict.fromkeys(units))}
        distinct, at = list(places), 0
        out = np.zeros((len(distinct), len(LANGUAGES)))
        while at < len(distinct):
            size, end = 0, at
            while end < len(distinct) and (size < _CHUNK or end == at):
                size += len(distinct[end])
                end += 1
            out[at:end] = self._bits(distinct[at:end])
            at = end
        return out[[places[u] for u in units]]

    def _bits(self, units: list[str]) -> np.ndarray:
        coded = [u.encode("utf-8", "replace") for u in units]
        data = np.frombuffer(_PAD + _PAD.join(coded) + _PAD, np.uint8)
        n = len(data) - ORDER
        cost = context = None
        for m in range(1, ORDER + 2):
            rows = self._find(m, _grams(data, m))
            # position p of the result is byte ORDER + p of data
            here = self.cost[m - 1].take(rows[ORDER + 1 - m :][:n], axis=0)
            if m == 1:
                cost = np.broadcast_to(self.bottom, here.shape)
            else:
                cost = np.add(self.escape[m - 2].take(context, axis=0), cost)
            np.copyto(here, cost, where=np.isnan(here))
            cost = here
            # the string of length m that ends one byte earlier is the context of the next order
            context = rows[ORDER - m :][:n] if m <= ORDER else None
        starts = np.cumsum([0] + [len(c) + len(_PAD) for c in coded[:-1]]) + len(_PAD) - ORDER
        lengths = np.array([len(c) for c in coded])
        sums = np.vstack([np.zeros((1, len(LANGUAGES))), np.cumsum(cost, axis=0, dtype=np.float64)])
        return sums[starts + lengths] - sums[starts]


def _grams(data: np.ndarray, m: int) -> np.ndarray:
    """All strings of m bytes as integers."""
    out = np.zeros(len(data) - m + 1, np.int64)
    for k in range(m):
        out = (out << 8) | data[k : k + len(out)]
    return out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def fit(labelled: list[tuple[str, list[str]]]) -> Models:
    """Models from (language, sentences) of labelled documents; see the module's text."""
    texts = {lang: sentences(SEEDS[lang]) for lang in LANGUAGES}
    first = {lang: list(s) for lang, s in texts.items()}
    for lang, units in labelled:
        first[lang] += units
    models = Models(first)
    flat = [(lang, u) for lang, units in labelled for u in units]
    for _ in range(ROUNDS if flat else 0):
        bits = models.bits([u for _, u in flat])
        kept = {lang: list(s) for lang, s in texts.items()}
        of = np.array([LANGUAGES.index(lang) for lang, _ in flat])
        own = bits[np.arange(len(flat)), of].copy()
        bits[np.arange(len(flat)), of] = np.inf
        for (lang, unit), clear in zip(flat, bits.min(1) - own >= CLEAR_BITS):
            if clear:
                kept[lang].append(unit)
        models = Models(kept)
    return models


def decode(bits: np.ndarray, switch: float = SWITCH_BITS) -> np.ndarray:
    """Language of each sentence: the cheapest path when each change costs `switch` bits."""
    n, k = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, k), np.int32)
    for i in range(1, n):
        least = int(cost.argmin())
        move = cost[least] + switch < cost
        back[i] = np.where(move, least, np.arange(k))
        cost = np.where(move, cost[least] + switch, cost) + bits[i]
    path = np.empty(n, np.int32)
    path[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def stretches(units: list[str], bits: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(first sentence, sentences, language, confidence) of the runs of one language.

    The confidence is the language's posterior probability with an eighth of the code length difference as evidence, as
    neighbouring bytes aren't independent.
    """
    if not units:
        return []
    best = bits.argmin(1)
    # where each sentence has the same shortest code no change can pay
    path, out, at = best if (best == best[0]).all() else decode(bits), [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[at]:
            total = bits[at:i].sum(0)
            less = np.exp2(-(total - total.min()) / 8)
            out.append((at, i - at, LANGUAGES[path[at]], float(less[path[at]] / less.sum())))
            at = i
    return out


def label_language(label: Column) -> Column:
    """The two-letter code a label names, null where it says nothing. Spelling, region and script don't matter."""
    head = F.lower(F.regexp_extract(F.trim(label), r"(?U)^([^\W\d_]+)(?:[-_\s(].*)?$", 1))
    out = F.when(head.isin(*LANGUAGES), head)
    for code, others in NAMES.items():
        out = out.when(head.isin(*others), F.lit(code))
    return out


def labelled_sample(df: DataFrame, key: str, text: str, label: str, kind: str | None) -> list[tuple[str, list[str]]]:
    """Sentences of about FIT_DOCS documents a language, never more than twice that for all, chosen by a hash of the key."""
    rows = df.where(F.col(text).isNotNull()).withColumn("__lang", label_language(F.col(label))).where("__lang IS NOT NULL")
    counts = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()}  # nine rows at most
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("__lang") == lang, F.lit(min(1.0, FIT_DOCS / n))).otherwise(share)
    code = (F.col(kind) == "code_file") if kind else F.lit(False)
    picked = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / 1_000_003.0 < share).select("__lang", F.substring(F.col(text), 1, FIT_CHARS).alias("t"), F.coalesce(code, F.lit(False)).alias("c"))
    return [(r["__lang"], sentences(r["t"], r["c"])) for r in picked.limit(2 * FIT_DOCS * len(LANGUAGES)).collect()]


def identify(df: DataFrame, key: str, text: str, kind: str | None, models) -> DataFrame:
    """(key, label, segment_no, first_sentence, sentences, lang, confidence): the stretches of each document, in order.

    `models`: a broadcast of `fit`'s result; `kind`: a column that is 'code_file' where the whole text is code, or None.
    A null key, and a null, empty or proseless text, give no rows. Repeated rows are repeated. Whole texts are read.
    """
    code = F.coalesce(F.col(kind) == "code_file", F.lit(False)) if kind else F.lit(False)
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), code.alias("code"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _PART):
                part = batch.iloc[at : at + _PART]
                docs = [sentences(t, c) for t, c in zip(part["text"], part["code"])]
                bits = models.value.bits([u for d in docs for u in d])
                out, start = [], 0
                for k, d in zip(part["key"], docs):
                    found = stretches(d, bits[start : start + len(d)])
                    out += [(k, no, *s) for no, s in enumerate(found, 1)]
                    start += len(d)
                yield pd.DataFrame(out, columns=["key", "segment_no", "first_sentence", "sentences", "lang", "confidence"])

    return spread(rows, "key").mapInPandas(judge, "key bigint, segment_no int, first_sentence int, sentences int, lang string, confidence double")


def relabel(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, lang): the languages of documents whose label is missing, says nothing or is wrong, or that have several.

    `labels`: (key, label). A language counts from RUN consecutive sentences on.
    """
    found = segments.where(F.col("sentences") >= RUN).groupBy("key").agg(F.collect_set("lang").alias("langs"))  # nine at most
    named = label_language(F.col("label"))
    off = named.isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce(named, F.lit("")))
    return labels.join(found, "key").where(off).select("key", F.explode("langs").alias("lang"))


def _segments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, root, "documents")
    models = spark.sparkContext.broadcast(fit(labelled_sample(docs, "doc_id", "text", "lang", "type")))
    return docs, identify(docs, "doc_id", "text", "type", models)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    docs, segments = _segments(spark, root)
    labels = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label"))
    return relabel(segments, labels).select(F.col("key").alias("doc_id"), "lang").distinct()


def p10_segments(spark: SparkSession, root: str) -> DataFrame:
    """Each stretch of text of one language, with its confidence."""
    return _segments(spark, root)[1].withColumnRenamed("key", "doc_id")
