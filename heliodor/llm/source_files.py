"""Problem 4: files that nobody wrote by hand: generated, minified, third-party, or data stored as code.

Three kinds of evidence, in this order. The path inside the archive. Containment: an inverted index holds the line hashes of all
distinct third-party files, which their folder or a note of origin tells; a file of another repository that has most of its lines
in a single one of them is a copy, edited or not, whatever its own path and header say. And for what remains its notes and the
composition of its text: the share of idioms of generators, of literals, of dense lines. A project's own files copied between
its samples hold no third-party lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.session import materialise, spread
from heliodor.sources.tables import read

#: Folders that hold third-party code, by whole name.
_FOREIGN_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third[-_]?party|3rd[-_]?party|node_modules|bower_components|carthage|pods|deps|dependencies|external|externals|submodules|site-packages)/|(?:^|/)(?:libraries|libs?|frameworks|packages)/[^/]+[-@_]v?\d+(?:\.\d+)+/", re.I)
#: Folders and names of generated files.
_MADE_PATH = re.compile(r"(?:^|/)(?:generated|gen|autogen|auto-generated|derived|deriveddata|derivedsources)/|\.(?:pb|g|gen|generated|grpc|freezed|designer)\.\w+$|_(?:pb2|pb2_grpc|generated)\.\w+$|(?:^|/)R\.(?:generated\.)?\w+$|\.pb\.(?:h|cc|m|mm|swift|go)$|\.pbobjc\.[hm]$|(?:^|/)moc_\w+\.cpp$", re.I)
_MINIFIED_PATH = re.compile(r"[.\-]min\.(?:js|css|json|mjs)$|\.(?:bundle|chunk)\.(?:[0-9a-f]{6,}\.)?(?:js|css|json|mjs)$|\.(?:chunk\.)?[0-9a-f]{8,}\.(?:js|css)$|\.min\.", re.I)
#: What generators write about a file, in its comments.
_MADE_NOTE = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[- ]?generated\s+(?:by|from|file|code|using|with)\b|\b(?:code|file|source|this file (?:was|is)|this (?:was|is))\s+(?:auto-?|automatically )?generated\s+(?:by|from|using|with)\b|\bgenerated by\b.{0,80}\bdo not (?:edit|modify|change)\b"
    r"|\bdo not (?:edit|modify|change)(?: this file)? by hand\b|\bchanges (?:to this file )?(?:will|may) be (?:lost|overwritten)\b|\b(?:this|the) (?:is an? )?(?:auto-?)?generated file\b|\bgenerated (?:file|code)[.;,:]?\s*(?:please )?do not (?:edit|modify)\b|\bedits? (?:will|may) be (?:lost|overwritten)\b|\boutput, \d+ bytes from\b"
    r"|\b(?:written|produced|created|emitted|made|built|exported)(?: automatically)? by (?:an? |the |our )?(?:[\w\-]+ )?(?:script|tool|generator|program|machine|compiler)\b|\brun the (?:script|tool|generator) again\b|\b(?:re-?run|regenerate) (?:it|this file|the file|with)\b", re.I
)
#: What third-party files say about where they come from, in their header.
_FOREIGN_NOTE = re.compile(
    r"\bupstream:|\bcopied (?:verbatim |unchanged )?(?:from|without changes)|\bpart of [\w.+\-]+ v?\d+(?:\.\d+)+|\bcopyright\b.{0,60}\b(?:contributors|authors|developers|foundation|project)\b|\b(?:vendored|imported|taken|mirrored) from\b.{0,80}|\bthird[- ]party (?:code|library|source)\b|\bLICENSE\.upstream\b|\bupstream (?:authors|project|version|release)\b", re.I
)
#: Idioms of generated accessors, decoders and resource tables.
_MADE_LINE = re.compile(r"\b_?(?:unique)?storage\(?\)?\._\w|\b_hasBits\s*&|\bdecodeSingular\w*Field|\bdecodeRepeated\w*Field|\b(?:Image|Color|Data|Font)Asset\(name:\s*\"[^\"]*\",\s*tag:\s*0x|\b_uniqueStorage\(\)|\bvisitSingular\w*Field|\bProtobuf_\w+|\bfileprivate\s+(?:static\s+)?var _\w+_:|\bGENERATED_\w+|\b__typename\b")
_BANNER = re.compile(r"^\s*/\*![^\n]{0,200}\bv?\d+(?:\.\d+)+")
_COMMENT_LINE = re.compile(r"^\s*(?://|/\*|\*|#(?!include|import|pragma|define|if|endif|else)|--|;|<!--|%)")
_PREAMBLE = re.compile(r"^\s*(?:import|@import|#include|#import|#pragma|package|using|use strict)\b")
#: A comment's mark at the margin (a block's star may stand one in) and the words before what a note says of its file.
_NOTE_START = re.compile(r"^(?://+!?|/\*+!?| ?\*+|#+(?!include|import|pragma|define|if|endif|else)|--+|;+|<!--+|%+)\s*(?:(?:note|warning|attention)\s*[:!]\s*)?(?:this (?:file|code|source) (?:is|was)\s+(?!(?:auto|generated)))?", re.I)
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*(?![\w.])")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_HEX = re.compile(r"(?<![\w])[0-9a-fA-F]{32,}(?!\w)")
_KEYED = re.compile(r"\"\w{1,24}\"\s*:\s*")
_WORDS = re.compile(r"[A-Za-z]{2,}")

#: Share of a file's lines that a single third-party file must hold, and the least lines of a file that is compared.
CONTAINED, LEAST_LINES = 0.6, 4
#: The least letters and digits of a line that enters the index.
LINE_LEAST = 10
#: Third-party files listed for a line in the first round; files that this leaves open are settled with all of them.
LISTED = 8
#: Lines that are salted are at most this many, and are held by more than this many files.
HOT = 50_000


def _path(url: str | None, local_path: str | None) -> str:
    """The file's path inside its archive."""
    if url and "#" in url:
        return url.split("#", 1)[1]
    return url or local_path or ""


def _comments(lines: list[str]) -> list[str]:
    out, block = [], False
    for line in lines:
        if block or _COMMENT_LINE.match(line):
            out.append(line)
        starts, ends = line.rfind("/*"), line.rfind("*/")
        block = starts > ends if starts >= 0 and (block or line.lstrip().startswith("/*")) else block and ends < 0
    return out


def _outside(lines: list[str]) -> tuple[list[str], list[str]]:
    """The comments before the first line of code, and those after the last, of any number: where notes stand in any form.

    Imports and preprocessor lines are no code here. Elsewhere a comment at the margin must begin with the note.
    """
    held = _comments(lines)
    at, first = 0, len(lines)
    for i, line in enumerate(lines):
        if at < len(held) and line is held[at]:
            at += 1
        elif line.strip() and not _PREAMBLE.match(line):
            first = i
            break
    at, last = len(held) - 1, -1
    for i in range(len(lines) - 1, -1, -1):
        if at >= 0 and lines[i] is held[at]:
            at -= 1
        elif lines[i].strip():
            last = i
            break
    return _comments(lines[:first]), _comments(lines[last + 1 :]) if last >= first else []


def judge_path(path: str) -> str | None:
    if _FOREIGN_DIR.search(path):
        return "third-party"
    if _MADE_PATH.search(path):
        return "generated"
    if _MINIFIED_PATH.search(path):
        return "minified"
    return None


def judge_text(path: str, body: str) -> str | None:
    """The reason a text gives by its notes and composition, or None. Null and blank texts give none."""
    if not body or not body.strip():
        return None
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    head, rest = _outside(lines)
    notes = _comments(lines)
    said = [line[m.end() :] for line in notes if (m := _NOTE_START.match(line))]
    if any(_MADE_NOTE.search(n) for n in (*head, *rest, " ".join(n.strip(" */#") for n in head[:6]))) or any(_MADE_NOTE.match(x) for x in said):
        return "generated"
    if any(_FOREIGN_NOTE.search(n) for n in head) or any(_FOREIGN_NOTE.match(x) for x in said):
        return "third-party"
    code = [x for x in lines if x.strip()]
    if len(code) >= 6 and sum(bool(_MADE_LINE.search(x)) for x in code) >= 0.3 * len(code):
        return "generated"
    bare = [x for x in code if not _COMMENT_LINE.match(x)]
    text = "\n".join(bare)
    if len(text) < 120:
        return None
    solid = re.sub(r"\s", "", text)
    blob = sum(len(m.group()) for m in _BASE64.finditer(text)) + sum(len(m.group()) for m in _HEX.finditer(text) if not _BASE64.search(m.group()))
    if blob >= 0.6 * len(solid):
        return "data"
    numbers = sum(len(m.group()) + 1 for m in _NUMBER.finditer(text))
    if numbers >= 0.55 * len(solid) and numbers >= 120:
        return "data"
    long_ = sum(len(x) for x in bare if len(x) > 300)
    if long_ >= 0.6 * len(text):
        if path.lower().endswith((".json", ".plist", ".xml", ".csv", ".geojson", ".svg")) or _KEYED.search(text):
            return "data"
        spaces = sum(c.isspace() for c in text)
        dense = sum(c in "{}();,=.:[]!?&|<>+-*/" for c in text)
        if spaces < 0.12 * len(text) and dense > 0.12 * len(text):
            return "minified"
    if _BANNER.match(body) and long_ >= 0.4 * len(text):
        return "minified"
    return None


def line_hashes(body: str) -> list[int]:
    """64-bit hashes of the distinct lines with at least LINE_LEAST letters and digits, spaces aside."""
    out = set()
    for line in body.splitlines():
        line = " ".join(line.split())
        if len(line) >= LINE_LEAST and sum(map(str.isalnum, line)) >= LINE_LEAST:
            out.add(xxhash.xxh3_64_intdigest(line))
    return np.array(sorted(out), np.uint64).view(np.int64).tolist()


def _shared(asking: DataFrame, sources: DataFrame) -> DataFrame:
    """(same, source, shared): lines of each asking text that each source listed for them holds. Both sides have line, part."""
    return asking.join(sources, ["line", "part"]).groupBy("same", "source").agg(F.count("*").alias("shared"))


def third_party_copies(texts: DataFrame, contained: float = CONTAINED, least: int = LEAST_LINES, listed: int = LISTED) -> DataFrame:
    """(same, low, high): the texts of which a single third-party text holds `contained` of the lines, and the first and last repository
    of those that do.

    `texts`: (same, foreign, seeks, low, high, lines), one row a text; low and high are the first and last repository in which it is
    third-party. Nothing is left out: the lines held by any third-party text bound the share from above; of the files that
    reach it, those that one of the `listed` first holders of each line doesn't settle are compared with all holders of their rarest lines.
    A line held by many files is split by the hash of the file; the hints are for at most HOT keys.
    """
    total = texts.agg(F.sum(F.size("lines"))).first()[0] or 0
    most = max(HOT, total // HOT)
    posted = texts.select("same", "foreign", "seeks", F.size("lines").alias("of"), F.explode("lines").alias("line"))
    index = posted.groupBy("line").agg(F.count_if("seeks").alias("n"), F.count_if("foreign").alias("held")).where("held > 0 AND n > 0")
    index = materialise(index.withColumn("parts", F.ceil(F.col("n") / most).cast("int")), "index")
    hot = F.broadcast(index.where("parts > 1").select("line", "parts"))  # at most total / most keys

    def parted(rows: DataFrame) -> DataFrame:
        return rows.join(hot, "line", "left").withColumn("part", F.pmod(F.xxhash64("same"), F.coalesce("parts", F.lit(1)))).drop("parts")

    held = index.select("line", "held", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    known = parted(posted.where(F.col("seeks") & (F.col("of") >= least)).select("same", "of", "line")).join(held, ["line", "part"])
    known = known.groupBy("same", "of").agg(F.array_sort(F.collect_list(F.struct("held", "line"))).alias("known"))  # the lines of one text
    enough = F.ceil(F.col("of") * contained)
    open_ = materialise(known.where(F.size("known") >= enough).withColumn("enough", enough), "contained")
    asking = open_.select("same", F.explode("known").alias("k")).select("same", "k.line")
    needed = asking.select("line").distinct()
    holders = posted.where("foreign").join(needed, "line", "left_semi").select("line", F.col("same").alias("source"))
    first = Window.partitionBy("line").orderBy(F.xxhash64("source"), "source")  # each task keeps its own first ones before the shuffle
    few = holders.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= listed).select("line", "source")
    few = few.join(hot, "line", "left").select("line", "source", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    found = materialise(_shared(parted(asking), few).join(open_.select("same", "enough"), "same").where("shared >= enough").select("same", "source"), "found")
    # the rest: files whose lines have more holders than were listed, by candidates from their rarest lines and exact comparison
    rest = open_.where(F.exists("known", lambda k: k["held"] > listed)).join(found, "same", "left_anti")
    rarest = F.slice("known", 1, F.size("known") - F.col("enough").cast("int") + 1)
    asked = rest.select("same", F.explode(rarest).alias("k")).select("same", "k.line")
    pairs = asked.join(holders, "line").select("same", "source").distinct()
    lines = texts.select(F.col("same").alias("source"), F.col("lines").alias("theirs"))
    exact = pairs.join(texts.select("same", "lines"), "same").join(lines, "source").where(F.size(F.array_intersect("lines", "theirs")) >= F.ceil(F.size("lines") * contained))
    found = found.unionAll(exact.select("same", "source"))
    where = texts.where("foreign").select(F.col("same").alias("source"), "low", "high")
    return found.join(where, "source").groupBy("same").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def judge_files(files: DataFrame) -> DataFrame:
    """(id, reason) of `files` (id, url, local_path, body) that aren't hand-written; an id is given once for each reason.

    An item in several chunks is judged by all of them. Null ids give no row; a null or blank body is judged by the path alone;
    repeated rows count once; other columns are ignored. No line and no file is left out of the index; exact copies share one entry.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, url, local, body in zip(b["id"], b["url"], b["local_path"], b["body"]):
                path, body = _path(url, local), body or ""
                by_path = judge_path(path)
                by_text = judge_text(path, body) if by_path != "third-party" else None
                foreign = "third-party" in (by_path, by_text)
                out.append((key, (url or "").split("#", 1)[0], by_path, by_text, foreign, xxhash.xxh3_128_digest(body), line_hashes(body)))
            yield pd.DataFrame(out, columns=["id", "repository", "by_path", "by_text", "foreign", "same", "lines"])

    judged = files.where("id IS NOT NULL").select("id", "url", "local_path", "body")
    schema = "id string, repository string, by_path string, by_text string, foreign boolean, same binary, lines array<bigint>"
    judged = materialise(spread(judged, "id").mapInPandas(first, schema), "judged")
    from_ = F.when(F.col("foreign"), F.col("repository"))
    texts = judged.groupBy("same").agg(F.max("foreign").alias("foreign"), F.max(F.col("by_path").isNull()).alias("seeks"), F.min(from_).alias("low"), F.max(from_).alias("high"), F.any_value("lines").alias("lines"))
    copies = third_party_copies(materialise(texts, "texts"))
    named = judged.select("id", "repository", "by_path", "by_text", "same").join(copies, "same", "left")
    elsewhere = (F.col("low") != F.col("repository")) | (F.col("high") != F.col("repository"))
    reason = F.coalesce("by_path", F.when(elsewhere, F.lit("third-party copy")), "by_text")
    return named.select("id", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def _project_files(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "content").where(F.col("type") == "code_file").select("id", "url", "local_path", "body")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return judge_files(_project_files(spark, root)).select("id").distinct()


def p4_reasons(spark: SparkSession, root: str) -> DataFrame:
    return judge_files(_project_files(spark, root))
