import re

import numpy as np
import pytest

from siltstone.llm.language import Classifier, codewords, label_documents, label_segments, languages_not_named, named_language, sentences, train
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"
TEXT = {
    "en": "The storage team measured how much room the old pictures take since the dates on both sides disagreed.",
    "es": "El equipo de almacenamiento midió cuánto espacio ocupan las fotos viejas porque las fechas no coincidían.",
    "de": "Die Archivleitung prüfte gestern alle alten Ordner, weil der freie Platz auf dem Band zu schnell schwand.",
    "fr": "Le bureau régional a mesuré la place occupée par les vieilles images puisque les dates ne concordaient pas.",
    "pt": "A equipa de armazenamento mediu quanto espaço ocupam as imagens antigas já que as datas não coincidiam.",
    "it": "La sede regionale ha misurato quanto spazio occupano le vecchie immagini perché le date non coincidevano.",
    "ru": "Группа хранения измерила, сколько места занимают старые снимки, потому что даты с обеих сторон расходились.",
}


LANGUAGES = tuple(TEXT)
DUTCH = ["De opslagploeg heeft gisteren gemeten hoeveel ruimte de oude foto's innemen omdat de datums niet klopten.", "Wij hebben vandaag nieuwe schijven besteld zodat er volgende week weer genoeg plaats is voor iedereen.",
         "Het kantoor bewaart alle bestanden nog minstens zeven jaar voordat iemand ze mag weggooien of verplaatsen."]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(real):
    return train(real, 2000)


def test_codewords_are_far_apart():
    code = codewords(7)
    assert min((code[i] != code[j]).sum() for i in range(7) for j in range(i)) >= 9


def test_held_out_accuracy(real, model):
    held = [r for r in real.orderBy("doc_id").collect()]
    texts, labels = [], []
    for r in held:
        name = re.match("[a-z]{2}$", r.lang or "")
        got = [w for _, _, w, n in sentences(r.text) if n >= 8] if name else []
        texts += got[:3]
        labels += [r.lang] * len(got[:3])
    best = model.decide(texts)[0]
    # Some labels are wrong by design: agreement can't be full.
    assert np.mean([LANGUAGES[b] == x for b, x in zip(best, labels, strict=True) if x in LANGUAGES]) > 0.85


def test_new_sentences_of_each_language(model):
    best, confidence, _ = model.decide([sentences_words(t) for t in TEXT.values()])
    assert [LANGUAGES[b] for b in best] == list(TEXT) and confidence.min() > 0.8


def sentences_words(text):
    return [w for _, _, words, _ in sentences(text) for w in words]


def test_segments_of_a_mixed_text(spark, model):
    text = TEXT["en"] + " " + TEXT["en"] + "\n\n" + TEXT["de"] + "\n2021-07-25T09:01:33Z d1[6247]: rc=3 sz=9377040 id=0x56f831\n/srv/v7/a/b.txt"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "2021-07-25T09:01:33Z rc=3 sz=9"), (None, TEXT["en"])], "doc_id long, text string")
    segments = label_segments(docs, model)
    rows = sorted((r.doc_id, r.segment_no, r.lang, r.whole) for r in segments.collect())
    assert rows == [(1, 0, "en", 2), (1, 1, "de", 1), (2, 0, "und", 0), (3, 0, "und", 0), (4, 0, "und", 0)]
    at = {r.segment_no: text[r.start : r.start + r.length] for r in segments.where("doc_id = 1").collect()}
    assert at == {0: TEXT["en"] + " " + TEXT["en"], 1: TEXT["de"]}
    assert {r.doc_id: r.lang for r in label_documents(segments).collect()} == {1: "en", 2: "und", 3: "und", 4: "und"}


def test_found_languages(spark, real):
    rows = [(-k - 1, TEXT[c], c) for k, c in enumerate(TEXT)] + [(-20, TEXT["fr"], "English"), (-21, TEXT["it"] + "\n" + TEXT["ru"], "it-CH"), (-22, TEXT["es"], None), (-23, "Short one here.", "de"), (-24, "", "de"), (-24, None, "de"), (-25, "x" * 300_000, "de"), (-22, TEXT["es"], None)]
    got = languages_not_named(real.unionByName(spark.createDataFrame(rows, DOCS)))
    assert sorted((r.doc_id, r.lang) for r in got.where("doc_id < 0").collect()) == [(-22, "es"), (-21, "ru"), (-20, "fr")]


def test_no_usable_labels(spark):
    assert languages_not_named(spark.createDataFrame([], DOCS)).collect() == []
    assert languages_not_named(spark.createDataFrame([(1, TEXT["en"], "??")], DOCS)).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 9, 15])
def test_codewords_of_any_number_differ(n):
    code = codewords(n)
    assert code.shape[0] == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_a_language_outside_is_undetermined(model):
    other = [*DUTCH, "Varastointiryhmä mittasi eilen kuinka paljon tilaa vanhat kuvat vievät koska päivämäärät eivät täsmänneet.", "Zespół zmierzył wczoraj ile miejsca zajmują stare zdjęcia ponieważ daty po obu stronach się nie zgadzały."]
    assert model.languages == LANGUAGES
    best, confidence, lead = model.decide([sentences_words(t) for t in other])
    assert (lead == 0).all() and (confidence == 0).all()


def test_languages_are_those_that_labels_name(spark, real):
    rng = np.random.default_rng(3)
    parts = [w for t in DUTCH for w in sentences_words(t)]
    dutch = [(-100 - k, " ".join(rng.choice(parts, 14)).capitalize() + ".", "nl") for k in range(150)]
    rows = dutch + [(-1, DUTCH[0], "en"), (-2, DUTCH[1], "nl-BE"), (-3, TEXT["de"], "nl")]
    got = languages_not_named(real.unionByName(spark.createDataFrame(rows, DOCS)))
    assert sorted((r.doc_id, r.lang) for r in got.where("doc_id between -10 and -1").collect()) == [(-3, "de"), (-1, "nl")]


def test_labels(spark):
    want = {"en": "en", "EN": "en", "en-GB": "en", "English": "en", "deu": "de", " pt_BR ": "pt", "Español": "es", "xx": None, "": None, "und": None, "unknown": None, None: None}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", named_language(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want


def test_classifier_travels(model):
    import pickle

    again = pickle.loads(pickle.dumps(model))
    assert isinstance(again, Classifier) and (again.weights == model.weights).all()
