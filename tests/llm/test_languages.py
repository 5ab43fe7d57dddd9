import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.llm import languages as L

TEXT = {
    "de": "Wir zeigen zuerst das Fenster. Danach wird die Datei geladen und geprüft.", "en": "First we show the window. Then the file is loaded and checked.", "es": "Primero mostramos la ventana. Después se carga el archivo y se comprueba.",
    "fr": "Nous montrons d'abord la fenêtre. Ensuite le fichier est chargé et vérifié.", "it": "Prima mostriamo la finestra. Poi il file viene caricato e verificato.", "ja": "最初にウインドウを表示します。次にファイルを読み込んで確認します。",
    "nl": "Eerst tonen we het venster. Daarna wordt het bestand geladen en gecontroleerd.", "pt": "Primeiro mostramos a janela. Depois o arquivo é carregado e verificado.", "zh": "我们首先显示窗口。然后加载文件并进行检查。",
}


@pytest.fixture(scope="module")
def models():
    return L.fit([])


def test_seeds_alone_tell_languages(models):
    for lang, text in TEXT.items():
        units = L.sentences(text)
        assert len(units) == 2
        assert [s[2] for s in L.stretches(units, models.bits(units))] == [lang]


def test_code_lengths_equal_a_plain_model(models):
    """PPM with escapes by the definition, for one language."""
    from collections import Counter, defaultdict

    seen = defaultdict(Counter)
    j = L.LANGUAGES.index("en")
    pad = b"\n" * (L.ORDER + 1)
    data = pad + pad.join(s.encode() for s in L.sentences(L.SEEDS["en"])) + pad
    for i in range(L.ORDER, len(data)):
        for n in range(L.ORDER + 1):
            seen[data[i - n : i]][data[i]] += 1

    def cost(context, symbol):
        counts = seen.get(context)
        shorter = lambda: cost(context[1:], symbol) if context else 8.0
        if not counts:
            return shorter()
        total, kinds = sum(counts.values()), len(counts)
        return np.log2((total + kinds) / counts[symbol]) if symbol in counts else np.log2((total + kinds) / kinds) + shorter()

    for text in ("the view is shown again.", "xyzzy qq", "中"):
        full = b"\n" * L.ORDER + text.encode()
        want = sum(cost(full[i - L.ORDER : i], full[i]) for i in range(L.ORDER, len(full)))
        assert abs(models.bits([text])[0][j] - want) < 1e-3


def test_sentences():
    text = "# Eine Überschrift hier steht\n\n- Das ist ein Satz.\n- Noch ein Satz hier.\n\n```swift\n// The first comment is here.\nlet a = 1\n// The second one is here.\n```\n\nEr sagt “buongiorno a tutti quanti” dazu. `code is not prose`\nZeile eins geht\nweiter bis hier."
    assert L.sentences(text) == ["das ist ein satz.", "noch ein satz hier.", "er sagt dazu.", "zeile eins geht weiter bis hier."]
    assert L.sentences("/*\n Ein Satz ist hier.\n*/\nint x = 1;\n// Noch ein Satz hier.", code=True) == ["ein satz ist hier.", "noch ein satz hier."]
    assert L.sentences(None) == [] and L.sentences("") == [] and L.sentences("let x = 1") == []
    assert L.sentences("0:01 We use WindowServer 3 here.&nbsp;It&#39;s fine now.<br/>Third one is here.") == ["we use here.", "it's fine now.", "third one is here."]


def test_labels(spark):
    given = {"en": "en", "EN": "en", "en_GB": "en", "English": "en", "eng": "en", "zh_Hans": "zh", "pt-BR": "pt", "Deutsch": "de", "jpn": "ja", "und": None, "": None, None: None, "??": None, "n/a": None, "xx": None, "mul": None, "wwdc ": None}
    rows = spark.createDataFrame([(k,) for k in given], "l string").select("l", L.label_language(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in rows} == given


def test_documents(spark, models):
    rows = [(1, TEXT["de"], "en", "doc"), (2, TEXT["de"], "German", "doc"), (3, TEXT["en"] + "\n\n" + TEXT["fr"], "en", "doc"), (4, TEXT["en"] + "\n\nBonjour tout le monde ici.", "en", "doc"), (5, TEXT["ja"], None, "doc"), (6, None, None, "doc"), (7, "", "xx", None), (8, "// " + TEXT["nl"].replace(". ", ".\n// "), "", "code_file"), (None, TEXT["de"], None, "doc"), (9, "let x = 1", "und", "code_file")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, lang string, type string, key string")
    b = spark.sparkContext.broadcast(models)
    segments = L.identify(df, "doc_id", "text", "type", b)
    found = L.relabel(segments, df.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "de"), (3, "en"), (3, "fr"), (5, "ja"), (8, "nl")]
    assert all(0.5 < r["confidence"] <= 1 for r in segments.collect())
    assert L.identify(df.where(F.lit(False)), "doc_id", "text", "type", b).count() == 0
    assert L.labelled_sample(df.where(F.lit(False)), "doc_id", "text", "lang", "type") == []
    long = L.sentences("The view draws its rows again. " * 50_000)
    assert len(L.stretches(long, models.bits(long))) == 1


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fitted = L.fit(L.labelled_sample(docs, "doc_id", "text", "lang", "type"))
    for lang, text in TEXT.items():
        units = L.sentences(text)
        assert [s[2] for s in L.stretches(units, fitted.bits(units))] == [lang]
