"""Problem 1: talk transcripts into clean, ordered speaker turns.

A transcript of any capture format is cut into pieces by its time marks or lines, and the pieces are put in time order. Who
speaks is decoded by a hidden Markov model whose states are the talk's listed speakers. It emits a piece's label, compared with
every speaker's name in the ways captions write names and with room for typing errors, and its words, by a language profile of
each speaker. A piece without a label goes on with the speaker before it, so the chain only moves at labels. Profiles and
transitions are estimated from the talk by rounds of decoding and counting, beginning with the pieces whose label fits one
speaker alone. They decide where labels don't: before the first label, and where a label fits several speakers or, by a
typing error, more than one name nearly.

Filler sounds and sound notes are removed, pieces with nothing left are dropped, and neighbours of one speaker are merged.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.residue import project_models, residue_reason
from heliodor.sources.tables import read

#: How transcripts write time marks, filler sounds and sound notes.
_TIME = r"\d{1,3}:[0-5]\d(?::[0-5]\d)?(?:[.,]\d{1,3})?"
_CUE = re.compile(rf"(?:^|\n)[ \t]*(?:\d+[ \t]*\r?\n)?[ \t]*({_TIME})[ \t]*-->[ \t]*{_TIME}[^\n]*\n?")
_LINE_MARK = re.compile(rf"^[ \t]*(?:(?P<lead>[^\n]{{0,60}}?)[\[\(](?P<in>{_TIME})[\]\)]|(?P<before>(?:>>[ \t]*)?[^\W\d_][^\n:\[\(\]]{{0,58}}:[ \t]*)?<?(?P<bare>{_TIME})>?)[ \t]*(?:[-–—][ \t]+)?", re.M)
_GLUED = re.compile(rf"(?<=\S)(?<![\d:,])(?<!\d\.)(?P<bare>{_TIME})(?=[^\W\d_]|[>\[\(<*{{♪\-])")
_SOUND_WORD = r"(?:u+h+m*|u+m+|e+rm*|e{2,}r+m*|h+m+|m+-?h+m+|m+m+|a+h+|e+h+|uh-huh)"
_FILLER = re.compile(rf"(?<![\w'’\-]){_SOUND_WORD}(?![\w'’]|-\w)(?:\s*(?:\.\.\.|…|[,;]|[-–—]+(?=\s|$)))*", re.I)
_NOTE = re.compile(r"--\s*\[[^\[\]\n]{1,60}\]\s*--|<(?P<tag>[ib]|em)>[^<>\n]{1,60}</(?P=tag)>|\[[^\[\]\n]{1,60}\]|\([^()\n]{1,60}\)|\{[^{}\n]{1,60}\}|(?<!\w)\*[^*\n]{1,60}\*(?!\w)|♪[^♪\n]{0,60}♪|[♪♫]+")
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
#: What may stand before the text as a label, by form. The name is always group 1.
_LABELS = (
    re.compile(r"^\s*(?:>>+|&gt;&gt;)\s*([^:\n]{1,60}?)\s*:\s*"),
    re.compile(r"^\s*<v(?:\.[\w.]+)?\s+([^>\n]{1,60})>\s*"),
    re.compile(r"^\s*\[([^\[\]\n]{1,60})\]\s*:?\s*"),
    re.compile(r"^\s*\(([^()\n]{1,60})\)\s*:?\s*"),
    re.compile(r"^\s*\*\*([^*\n:]{1,60}):?\*\*\s*:?\s*"),
    re.compile(r"^\s*([^:\n]{1,60}?)\s*:\s*"),
    re.compile(r"^\s*([^\n–—]{1,40}?)\s+[–—]\s+"),
    re.compile(r"^\s*([^\n]{1,40}?)\s+-{1,2}\s+"),
)
_NUMBERED = re.compile(r"^(?:speaker|spk|spkr|s|voice|participant)[ _\-#]*0*(\d{1,3})$", re.I)

#: Nats a unit of label cost weighs; share of the evidence of a word, as neighbouring words aren't independent; the most rounds.
LABEL_WEIGHT, WORD_WEIGHT, ROUNDS = 4.0, 0.25, 4
#: What a word and a transition count before any was seen.
UNSEEN_WORD, UNSEEN_MOVE = 0.5, 0.5


class Piece(NamedTuple):
    time: float
    label: str
    text: str


def _seconds(mark: str) -> float:
    parts = mark.replace(",", ".").split(":")
    return sum(float(p) * 60**k for k, p in enumerate(reversed(parts)))


def _segments(transcript: str) -> list[tuple[float | None, str]]:
    """(time, text with its label) of each piece in written order."""
    text = transcript.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    cues = list(_CUE.finditer(text))
    if cues:
        ends = [m.start() for m in cues[1:]] + [len(text)]
        return [(_seconds(m.group(1)), text[m.end() : e]) for m, e in zip(cues, ends)]
    at_lines = [(m.start(), m.end(), m["in"] or m["bare"], m["lead"] or m["before"] or "") for m in _LINE_MARK.finditer(text)]
    taken = [(a, b) for a, b, _, _ in at_lines]
    glued = [(m.start(), m.end(), m["bare"], "") for m in _GLUED.finditer(text) if not any(a <= m.start() < b for a, b in taken[max(0, bisect(taken, (m.start(),)) - 2) :][:4])]
    marks = sorted(at_lines + glued)
    if marks:
        ends = [m[0] for m in marks[1:]] + [len(text)]
        out = [(None, text[: marks[0][0]])] if text[: marks[0][0]].strip() else []
        return out + [(_seconds(time), label + text[b:e]) for (_, b, time, label), e in zip(marks, ends)]
    return [(None, line) for line in text.split("\n") if line.strip()]


def _distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        if min(row) > most and min(rows[-1]) > most:
            return most + 1
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def _forms(name: str) -> dict[str, float]:
    """Ways captions write a name, in lower case without marks, with the cost of each."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return {}
    out = {" ".join(words): 0.0}
    if len(words) > 1:
        first, last = words[0], words[-1]
        for form, cost in ((f"{last} {first}", 0.1), (f"{first[0]} {last}", 0.3), (f"{first} {last[0]}", 0.3), (f"{first} {last}", 0.0), (last, 0.5), (first, 0.5), (f"{first[0]}{last[0]}", 1.5)):
            out.setdefault(form, cost)
    return out


class Names:
    """The listed speakers of a talk by the names and numbers a label may give them. Each different label is compared once."""

    def __init__(self, listed: list[tuple[int, str | None]]):
        self.forms = [(n, _forms(name or "")) for n, name in listed if n is not None]
        self.numbers = {n for n, _ in self.forms}
        self.known: dict[str, dict[int, float]] = {}

    def fits(self, label: str) -> dict[int, float]:
        """Cost of each speaker the label may name; empty if it names nobody listed."""
        label = label.strip()
        if label not in self.known:
            self.known[label] = self._fits(label)
        return self.known[label]

    def _fits(self, label: str) -> dict[int, float]:
        if m := _NUMBERED.match(label):
            n = int(m.group(1))
            return {n: 0.0} if n in self.numbers else {}
        said = " ".join(w.lower() for w in _WORD.findall(label))
        if not said:
            return {}
        if exact := {n: forms[said] for n, forms in self.forms if said in forms}:
            return exact  # a name that is written as listed is no misspelling of another
        out: dict[int, float] = {}
        for number, forms in self.forms:
            for form, cost in forms.items():
                if len(form) >= 5 and (d := _distance(said, form, most := 2 if len(form) >= 9 else 1)) <= most:
                    out[number] = min(out.get(number, math.inf), cost + 2.5 * d)
        return out


def strip_sounds(text: str) -> str:
    """The text without sound notes and filler sounds; '' if nothing was spoken."""
    text = _NOTE.sub(" ", text)
    text = _FILLER.sub(" ", text)
    text = _SPACES.sub(" ", text).strip()
    text = re.sub(r"\s+([,.;:!?])", r"\1", text)
    text = re.sub(r"^[\s,.;:!?…\-–—]+", "", text)
    return text if _WORD.search(text) else ""


def _take_label(text: str, names: Names) -> tuple[dict[int, float], str]:
    """(speakers the label may name, the text after it)."""
    rest, lead = text, ""
    for _ in range(3):
        for form in _LABELS:
            if (m := form.match(rest)) and (fits := names.fits(m.group(1))):
                return fits, lead + rest[m.end() :]
        note = _NOTE.match(rest.lstrip())
        if not note:
            break
        rest = rest.lstrip()[note.end() :]
    return {}, text


def _path(pieces: list[tuple[dict[int, float], Counter]], speakers: list[int], said: dict[int, Counter], moves: dict[tuple[int, int], int]) -> list[int]:
    """The likeliest speakers under profiles and transitions with the counts `said` and `moves`: Viterbi."""
    kinds = len(set().union(*said.values())) + 1
    sums = {s: sum(c.values()) for s, c in said.items()}
    leaves = {s: sum(moves.get((s, t), 0) for t in speakers) for s in speakers}
    move = {(s, t): -math.log((moves.get((s, t), 0) + UNSEEN_MOVE) / (leaves[s] + UNSEEN_MOVE * len(speakers))) for s in speakers for t in speakers}

    def emit(fits: dict[int, float], words: Counter) -> dict[int, float]:
        out = {}
        for s in fits or speakers:
            profile = -sum(k * math.log((said[s][w] + UNSEEN_WORD) / (sums[s] + UNSEEN_WORD * kinds)) for w, k in words.items()) if len(fits) != 1 else 0.0
            out[s] = LABEL_WEIGHT * fits.get(s, 0.0) + WORD_WEIGHT * profile
        return out

    cost: dict[int, float] = {}
    back: list[dict[int, int]] = []
    for at, (fits, words) in enumerate(pieces):
        if not fits and len(cost) == 1:  # one way to go on, whatever the words
            back.append({s: s for s in cost})
            continue
        here = emit(fits, words)
        if at == 0:
            cost = here
        elif fits:
            step = {t: min(cost, key=lambda s: (cost[s] + move[s, t], s)) for t in here}
            cost = {t: cost[s] + move[s, t] + here[t] for t, s in step.items()}
            back.append(step)
        else:  # no label, no change
            cost = {s: c + here[s] for s, c in cost.items()}
            back.append({s: s for s in cost})
    path = [min(cost, key=lambda s: (cost[s], s))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def decode(pieces: list[tuple[dict[int, float], str]], speakers: list[int], rounds: int = ROUNDS) -> list[int]:
    """The likeliest speaker of each piece (costs of the speakers its label may name, text).

    Profiles and transitions are first counted over the pieces whose label fits one speaker, then over the path found with
    them, until it stays the same or for `rounds` rounds.
    """
    if len(speakers) == 1 or not pieces:
        return [speakers[0]] * len(pieces)
    counted = [(fits, Counter(w.lower() for w in _WORD.findall(text))) for fits, text in pieces]
    known: list[int | None] = [next(iter(fits)) if len(fits) == 1 else None for fits, _ in pieces]
    for _ in range(rounds):
        said, moves, last = {s: Counter() for s in speakers}, Counter(), None
        for s, (fits, words) in zip(known, counted):
            if s is not None:
                said[s].update(words)
                if fits and last is not None:
                    moves[last, s] += 1
                last = s
        path = _path(counted, speakers, said, moves)
        if path == known:
            break
        known = path
    return path


def turns(transcript: str, listed: list[tuple[int, str | None]]) -> list[tuple[int, int, float | None, str]]:
    """(turn_no, speaker_no, start in seconds or None, clean text) of a transcript. Nobody listed: no turns."""
    speakers = sorted({n for n, _ in listed if n is not None})
    if not speakers or not transcript:
        return []
    names = Names(listed)
    segments = _segments(transcript)
    if any(t is not None for t, _ in segments):
        last, timed = -1.0, []
        for t, text in segments:
            last = last if t is None else t
            timed.append((last, text))
        segments = sorted(timed, key=lambda x: x[0])
    labelled = []
    for t, text in segments:
        fits, rest = _take_label(text, names)
        labelled.append((t, fits, strip_sounds(rest)))
    who = decode([(f, x) for _, f, x in labelled], speakers)
    out: list[tuple[int, int, float | None, str]] = []
    for (t, _, text), s in zip(labelled, who):
        if not text:
            continue
        if out and out[-1][1] == s:
            out[-1] = (*out[-1][:3], f"{out[-1][3]} {text}")
        else:
            out.append((len(out) + 1, s, None if t is None or t < 0 else t, text))
    return out


def speaker_turns(talks: DataFrame, speakers: DataFrame, models=None) -> DataFrame:
    """(id, turn_no, speaker_no, start, text) of `talks` (id, transcript), whose speakers are in `speakers` (id, speaker_no, display_name).

    Null and blank transcripts, talks without listed speakers and, given residue `models`, transcripts that are residue
    give no rows. Rows repeated exactly count once. A talk with several different transcripts gives the turns of each.
    """
    listed = speakers.where("id IS NOT NULL AND speaker_no IS NOT NULL").groupBy("id").agg(F.collect_set(F.struct("speaker_no", "display_name")).alias("listed"))  # those of one talk
    rows = talks.where("id IS NOT NULL AND length(trim(transcript)) > 0").select("id", "transcript").distinct().join(listed, "id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, who in zip(b["id"], b["transcript"], b["listed"]):
                if models is not None and residue_reason(text, models.value):
                    continue
                out.extend((key, *turn) for turn in turns(text, [(w["speaker_no"], w["display_name"]) for w in who]))
            yield pd.DataFrame(out, columns=["id", "turn_no", "speaker_no", "start", "text"])

    return rows.mapInPandas(cut, "id string, turn_no int, speaker_no int, start double, text string")


def p1_turns(spark: SparkSession, root: str) -> DataFrame:
    talks, speakers = read(spark, root, "wwdc_content"), read(spark, root, "talk_speakers")
    return speaker_turns(talks, speakers, project_models(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_turns(spark, root).select("id", "turn_no", "speaker_no").distinct()
