import random

import pytest

from mnesis.llm.leaks import find_leaks

WORDS = [f"{a}{b}{c}" for a in ("bor", "cal", "dun", "fel", "gor") for b in ("ami", "elo", "ira", "usa") for c in ("n", "rt", "ck", "ld", "th")]
rng = random.Random(0)
ITEM = [rng.choice(WORDS) + str(i % 7) for i in range(90)]
OTHER = "Rain soaked the 811 ballots which Kappa had stored beneath the Quillbury town hall and only 96 seedlings that Delta planted along the canal survived the frost of the year".split()


def leak(spark, text, items=None):
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, None, 5, "x"), (3, "", 5, "x")], "doc_id bigint, text string, item_id int, share string")
    items = items or [(10, " ".join(ITEM)), (11, " ".join(OTHER)), (12, None)]
    return sorted((r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect())


FILL = "we met on the way and talked about nothing in particular "
CASES = {
    "whole": (FILL + " ".join(ITEM) + " " + FILL, True), "third": (FILL + " ".join(ITEM[30:61]) + " " + FILL, True), "short": (FILL + " ".join(ITEM[30:52]) + " " + FILL, False),
    "upper and wrapped": (FILL + "\n> ".join(" ".join(ITEM[i : i + 8]).upper() for i in range(0, 48, 8)), True), "spaced": ("   ".join(ITEM[:40]), True),
    "altered": (" ".join("also" if i % 11 == 5 else w for i, w in enumerate(ITEM[:60])), True), "lost words": (" ".join(w for i, w in enumerate(ITEM[:60]) if i % 13 != 5), True),
    "chat lines": ("\n".join(f"2025-01-14, 15 h {i:02d} - D.: " + " ".join(ITEM[i : i + 9]) for i in range(0, 54, 9)), True), "list": ("\n".join(f"{i + 1}. " + " ".join(ITEM[i * 9 : i * 9 + 9]) for i in range(6)), True),
    "two halves apart": (" ".join(ITEM[:18]) + " " + FILL * 30 + " ".join(ITEM[40:58]), False), "shuffled": (" ".join(sorted(ITEM)), False), "none": (FILL * 20, False), "signs": ("… 😂 --", False),
    "long": (FILL * 4000 + " ".join(ITEM[:40]) + " " + FILL * 4000, True),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    text, want = CASES[name]
    assert leak(spark, text) == ([(1, 10)] if want else [])


def test_same_phrases_about_other_facts(spark):
    other = "Rain soaked the 186 ballots which Orbit had stored beneath the Tessaline town hall and only 12 seedlings that Noor planted along the river survived the frost of the week"
    assert leak(spark, other) == [] and leak(spark, " ".join(OTHER)) == [(1, 11)]


def test_empty_tables(spark):
    assert leak(spark, "x", [(1, "")]) == []
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert find_leaks(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
