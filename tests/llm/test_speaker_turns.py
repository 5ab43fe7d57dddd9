import pytest
from pyspark.sql import functions as F

from heliodor.llm.speaker_turns import Names, speaker_turns, strip_sounds, turns

WHO = [(1, "Ada Lovett"), (2, "Bo Hartmann"), (3, "Cy Novak")]


def run(text, who=WHO):
    return [(n, s, t) for n, s, _, t in turns(text, who)]


@pytest.mark.parametrize(
    "text",
    [
        "0:01 Ada Lovett: Hello all.\n\n0:09 Bo Hartmann: Hi there.\n\n0:12 More from me.",
        "[00:00:01] ADA LOVETT: Hello all.\n[00:00:09] Hartmann, Bo: Hi there.\n[00:00:12] More from me.",
        "1\n00:00:01.000 --> 00:00:02.000\n[Ada Lovett] Hello all.\n\n2\n00:00:09.000 --> 00:00:10.000\n>> Bo Hartmann: Hi there.\n\n3\n00:00:12.000 --> 00:00:13.000\nMore from me.",
        "0:01Ada Lovett: Hello all.0:09(Bo) Hi there.0:12More from me.",
        "Ada Lovett: [00:00:01] Hello all.\nHartman, Bo: [00:00:09] Hi there.\n[00:00:12] More from me.",
        "00:00:01,500 Speaker 1: Hello all.\n\n00:00:09,500 SPK_02: Hi there.\n\n00:00:12,500 More from me.",
        "ada lovett : Hello all.\nB. Hartmann: Hi there.\nMore from me.",
        "0:09 Hartmann — Hi there.\n0:12 More from me.\n0:01 Lovett — Hello all.",
    ],
)
def test_formats(text):
    assert run(text) == [(1, 1, "Hello all."), (2, 2, "Hi there. More from me.")]


def test_sounds():
    assert strip_sounds("Um, so [laughter] we uh... begin — er — now. ♪ music ♪ *chuckles* {pause} <i>whoosh</i> -- [clears throat] --") == "so we begin — now."
    assert strip_sounds("Mm-hmm. (applause)") == "" and strip_sounds("Uh-huh.") == "" and strip_sounds("♪♪") == ""
    assert strip_sounds("The error err handles umbrellas.") == "The error err handles umbrellas."
    assert run("0:01 Ada Lovett: One.\n0:02 Bo Hartmann: Um.\n0:03 Ada Lovett: Two.") == [(1, 1, "One. Two.")]


def test_notes_are_no_labels():
    assert run("0:01 Ada Lovett: One.\n0:02 Note: keep this.\n0:03 Step 2: and this.") == [(1, 1, "One. Note: keep this. Step 2: and this.")]


def test_one_speaker_and_profiles():
    assert run("Hello.\nThere.", [(4, "Di Ek")]) == [(1, 4, "Hello. There.")]
    labelled = "".join(f"Ada Lovett: apples and pears {i}.\nBo Hartmann: rockets over mars {i}.\n" for i in range(5))
    assert run("Rockets over mars now.\n" + labelled)[0][1] == 2
    assert run("x", []) == [] and run("", WHO) == []


def test_table(spark):
    talks = spark.createDataFrame([("t", "0:01 Ada Lovett: Hi.", 1), ("t", "0:01 Ada Lovett: Hi.", 1), ("n", None, 1), ("b", "  ", 1), ("q", "Hi.", 1), (None, "Hi.", 1)], "id string, transcript string, speaker_no int")
    who = spark.createDataFrame([("t", 1, "Ada Lovett"), ("t", 2, None), ("t", 1, "Ada Lovett"), ("n", 1, "X Y"), ("b", 1, "X Y"), (None, 1, "X Y")], "id string, speaker_no int, display_name string")
    assert [tuple(r) for r in speaker_turns(talks, who).collect()] == [("t", 1, 1, 1.0, "Hi.")]
    assert speaker_turns(talks.where(F.lit(False)), who).count() == 0
    assert speaker_turns(talks, who.where(F.lit(False))).count() == 0
    long = "0:01 Ada Lovett: " + "word " * 300_000
    assert len(run(long)) == 1


FRUIT, SPACE = [f"the {a} tree bears {b} in {c}" for a in ("apple", "pear", "plum") for b in ("blossom", "fruit") for c in ("may", "june")], [f"our {a} reaches {b} after {c}" for a in ("rocket", "probe", "lander") for b in ("mars", "venus") for c in ("launch", "burn")]


def _talk(first, second):
    """Two speakers, two labelled pieces each in turn, so that staying and changing are alike likely."""
    return "".join(f"{first}: {x}.\n{first}: {y}.\n{second}: {v}.\n{second}: {w}.\n" for x, y, v, w in zip(FRUIT[::2], FRUIT[1::2], SPACE[::2], SPACE[1::2]))


def test_labels_that_fit_two_speakers_are_decided_by_profiles():
    who = [(1, "Ada Lovett"), (2, "Bea Lovett")]
    text = _talk("Ada Lovett", "Bea Lovett") + "Lovett: so our probe reaches venus after launch.\nLovett: the plum tree bears blossom in may.\n"
    found = run(text, who)
    assert [s for _, s, _ in found] == [1, 2] * 6 + [1] and found[-2][2].endswith("after launch.") and found[-1][2] == "the plum tree bears blossom in may."


def test_misspelt_labels_near_two_names_are_decided_by_profiles():
    who = [(1, "Hans Meyerhof"), (2, "Hans Meyerhoff-Kern"), (3, "Hans Meierhof")]
    text = _talk("Hans Meyerhof", "Hans Meierhof") + "Hans Meerhof: our lander reaches mars after launch.\n"
    assert Names(who).fits("Hans Meerhof").keys() == {1, 3} and run(text, who)[-1][1] == 3


def test_pieces_before_the_first_label_go_together():
    text = "our probe reaches mars.\nafter the burn we launch the lander.\n" + _talk("Ada Lovett", "Bo Hartmann")
    assert [s for _, s, _ in run(text)][:3] == [2, 1, 2]


def test_rounds_learn_from_decoded_pieces():
    """Words that only occur in pieces whose speaker the first round has found decide the last pieces."""
    who = [(1, "Ada Lovett"), (2, "Bea Lovett")]
    text = _talk("Ada Lovett", "Bea Lovett") + "Lovett: the apple tree bears fruit for cider vinegar juice barrels.\n" * 3 + "Lovett: our rocket reaches mars with module antenna cargo fuel.\n" * 3
    text += "Lovett: cider vinegar juice barrels.\nLovett: module antenna cargo fuel.\n"
    found = run(text, who)
    assert [s for _, s, _ in found][-2:] == [1, 2] and found[-1][2] == "module antenna cargo fuel."


def test_no_label_no_change():
    text = _talk("Ada Lovett", "Bo Hartmann") + "the apple tree bears fruit in june.\nthe pear tree bears blossom in may.\n"
    assert run(text)[-1][1] == 2 and run(text)[-1][2].endswith("the pear tree bears blossom in may.")
