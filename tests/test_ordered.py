import random

import pytest
from pyspark.sql import functions as F

from mnesis.operators import features, ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(0, 400), i, rng.choice(["x", "y", None])) for i in range(500)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_agrees_with_a_plain_loop(spark, rows, width):
    df = spark.createDataFrame(rows, "s string, t bigint, id bigint, v string")
    x = ordered.previous(df, "s", "t", "id", {"p": "id"}, width)
    x = ordered.last_known(x, "s", "t", "id", "v", "k", width)
    x = ordered.row_index(x, "s", "t", "id", "i", width)
    got = {r.id: (r.p, r.k, r.i) for r in x.collect()}
    want = {}
    for s in {r[0] for r in rows}:
        before = known = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))):
            want[r[2]] = (before, known, n)
            before, known = r[2], r[3] if r[3] is not None else known
    assert got == want


def test_frames_in_blocks(spark):
    df = spark.createDataFrame([("s", i, i) for i in range(50)], "s string, t bigint, id bigint")
    x = ordered.in_blocks(df, "s", "t", 3, 10)
    assert x.where("_own").count() == 50 and x.where("not _own").count() == 15
    c = features.context_text(df.withColumns({"a": F.lit("u"), "c": F.col("id").cast("string")}), "s", "a", "t", "id", "c", 2).where("id = 20").collect()[0]
    assert c.context == "passage: [u] 18 | [u] 19 | [u] 20"


def test_empty(spark):
    df = spark.createDataFrame([], "s string, t bigint, id bigint")
    assert features.islands(df, "s", "t", "id", 5).count() == 0
