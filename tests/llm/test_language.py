import random

import pytest
from pyspark.sql import functions as F

from mnesis.llm import language as L

PARTS = {
    "en": ("the children were happy with their teacher", "nothing has moved since the meeting of last week", "could you check whether the office received it", "we should call them again before the weekend"),
    "fr": ("les enfants sont contents de leur maîtresse", "rien n'a bougé depuis la réunion de la semaine", "peux-tu vérifier si le bureau a bien reçu", "nous devrons les rappeler avant la fin de semaine"),
    "de": ("die Kinder sind mit ihrer Lehrerin zufrieden", "seit der letzten Woche hat sich nichts getan", "kannst du bitte prüfen ob das Büro ihn hat", "wir müssen sie vor dem Wochenende noch anrufen"),
    "ru": ("дети очень довольны своей новой учительницей", "с прошлой недели ничего не изменилось у нас", "проверь пожалуйста получили ли в бюро запрос", "мы должны позвонить им до конца недели снова"),
}
SCHEMA = "doc_id bigint, text string, lang string, label string, n_segments string"


def sentence(rng, lang):
    s = " und ".join([rng.choice(PARTS[lang])]) if lang == "de" else rng.choice(PARTS[lang])
    return s[0].upper() + s[1:] + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        lang = rng.choice(list(PARTS))
        label = lang if rng.random() > 0.1 else rng.choice(list(PARTS))
        rows.append((i, " ".join(sentence(rng, lang) for _ in range(4)), label, None, None))
    return L.fit_on(spark.createDataFrame(rows, SCHEMA))


def relabel(spark, model, rows):
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)
    return sorted((r.doc_id, r.seg_no, r.lang) for r in L.relabel(df, model).collect())


def test_held_out_accuracy(model):
    rng = random.Random(9)
    texts = [(lang, sentence(rng, lang).replace("é", "e")) for lang in PARTS for _ in range(50)]
    p = model.probabilities([t for _, t in texts])
    assert sum(model.languages[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), texts)) / len(texts) > 0.97


def test_labels(spark, model):
    fr, en, ru = (" ".join(x[0].upper() + x[1:] + "." for x in PARTS[k]) for k in ("fr", "en", "ru"))
    rows = [(1, fr, "fr"), (2, fr, "fr-CA"), (3, fr, "fra"), (4, fr, "FR_fr"), (5, fr, "en"), (6, fr, None), (7, en, "und"), (8, ru, ""), (9, None, None), (10, "", "en"), (11, "👍👍 …", None), (12, "https://example.org/a 123", "fr"), (13, en * 300, "de")]
    assert relabel(spark, model, rows) == [(5, 1, "fr"), (6, 1, "fr"), (7, 1, "en"), (8, 1, "ru"), (13, 1, "en")]


def test_stretches_in_text_order(spark, model):
    fr, en = (" ".join(x[0].upper() + x[1:] + "." for x in PARTS[k]) for k in ("fr", "en"))
    chat = "\n".join(f"2024-01-02, 15 h 0{i} - F.: {t[0].upper() + t[1:]}." for i, t in enumerate(PARTS["en"][:2] + PARTS["fr"][:2]))
    rows = [(1, fr + " " + en, "fr"), (2, chat, None), (3, en + " Ciao. Merci !", "en"), (4, en + " " + fr + " " + en, "en")]
    assert relabel(spark, model, rows) == [(1, 1, "fr"), (1, 2, "en"), (2, 1, "en"), (2, 2, "fr"), (4, 1, "en"), (4, 2, "fr"), (4, 3, "en")]


def test_no_labelled_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "the children were happy", None, "z", "z")], SCHEMA)
    assert L.relabel(df).count() == 0 and L.relabel(df.where(F.lit(False))).count() == 0
