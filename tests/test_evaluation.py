import pytest
from pyspark.sql import functions as F

from mnesis.operators import evaluation as E


def test_boundary_sets(spark):
    b = lambda *xs: spark.createDataFrame([(x,) for x in xs], "boundary int")
    cases = E.boundary_cases(b(1, 2, 3, 3), b(2, 3, 9))
    assert {(r.boundary, r.kind) for r in cases.collect()} == {(1, "FN"), (2, "TP"), (3, "TP"), (9, "FP")}
    r = E.boundary_prf(cases).collect()[0]
    assert (r.tp, r.prec, r.rec) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert E.boundary_prf(E.boundary_cases(b(), b())).collect()[0].f1 == 0
    assert E.sample_cases(cases, 1).count() == 3
    m = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "e string, i int")
    assert [r.boundary for r in E.predicted_boundaries(m, "e", "i").collect()] == [2]
    assert E.keep_large(m, "e", 2).count() == 2


def test_retrieval(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, item_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "x")], "query_id int, item_id string")
    r = E.retrieval_metrics(ranked, relevant).collect()[0]
    assert (r.recall_at_1, r.recall_at_3, r.mrr) == (0.0, 0.25, 0.25)


def test_annotation_sets(spark):
    found = spark.createDataFrame([(0, 3), (0, 60), (1, 48), (1, 3)], "chunk_no int, boundary int")
    bounds = spark.createDataFrame([(0, 0, 50), (1, 45, 95)], 'chunk_no int, start int, `end` int')
    silver = E.silver_boundaries(found, bounds)
    assert sorted(r.boundary for r in silver.collect()) == [3, 48]
    gaps = spark.createDataFrame([(3, 0.1), (48, 2.0)], "artifact_idx int, next_gap_hours double")
    assert sorted(r.boundary for r in E.reviewed_boundaries(silver, gaps, spark.createDataFrame([(7,)], "boundary int")).collect()) == [7, 48]


@pytest.mark.parametrize("hidden", [None, 4])
def test_boundary_model_learns_the_gap(spark, hidden):
    rows, t = [], 0
    for i in range(200):
        t += 600_000_000 * 60 if i % 10 == 0 else 60_000_000
        rows.append(("s", t, i, "a", "some words in a message", [1.0, 0.0], int(i % 10 == 0 and i > 0)))
    df = spark.createDataFrame(rows, "s string, us bigint, id int, a string, c string, v array<double>, y int")
    f = E.boundary_features(df, "s", "us", "id", "a", "c", "v")
    p = E.boundary_probability(E.train_boundary_model(f.where("id > 0"), "y", hidden), f.where("id > 0"))
    assert p.where((F.col("boundary") > 0.5) != (F.col("y") == 1)).count() == 0
