from pyspark.sql import functions as F

from mnesis.operators import enrich
from mnesis.plans import further
from mnesis.sources.writers import touch


def test_touch_keeps_the_other_rows(spark):
    e = spark.createDataFrame([("a", 1, 7), ("b", None, 9), ("c", 2, None)], "episode_id string, access_count int, last_accessed_us bigint")
    got = {r.episode_id: (r.access_count, r.last_accessed_us) for r in touch(e, e.where("episode_id = 'b'"), 50).collect()}
    assert got == {"a": (1, 7), "b": (1, 50), "c": (2, None)}


def test_injection_takes_compatible_names_in_order(spark):
    m = [(1, "Budget  Plan", "PROJECT", "A"), (2, "ANNA", "HANDLE", "A"), (3, "anna", "PLACE", "A"), (4, "budget plan!", "UNKNOWN", "A"), (5, None, "X", "A"), (6, "anna", "PERSON", None), (7, "anna", "PERSON", "B")]
    mentions = spark.createDataFrame([(*x, 1) for x in m], "mention_id bigint, surface_form string, entity_type string, source_artifact_id string, name int")
    c = spark.createDataFrame([("E2", "Anna B", "PERSON", ["anna"]), ("E1", "budget plan", "CONCEPT", None), ("E3", None, None, ["anna"])], "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    got = {r.artifact_id: r.names for r in enrich.injected_entities(mentions, c).collect()}
    assert got == {"A": ["budget plan", "Anna B"], "B": ["Anna B"]}
    assert enrich.injected_entities(mentions.limit(0), c).count() == 0


def test_participants_leave_the_entities(spark):
    rows = [("1", "Ann", ["budget", " ann ", None]), ("2", None, ["BOB"]), ("3", "bob", None), ("3", "bob", None)]
    df = spark.createDataFrame(rows, "artifact_id string, author string, entities array<string>")
    got = sorted((r.artifact_id, r.kept, r.removed) for r in enrich.without_participants(df, "author", "entities").collect())
    assert [g[0] for g in got] == ["1", "2", "3", "3"] and "budget" in got[0][1] and got[0][2] == [" ann "] and got[1][2] == ["BOB"] and got[2][1] is None


def test_statistics_and_fusion_of_empty_and_constant_tables(spark):
    df = spark.createDataFrame([(0.2, 1.0), (0.2, 3.0), (None, 2.0)], "p double, q double")
    s = enrich.boundary_statistics(df, "p").first()
    assert (s.n, s.n_boundaries, s.rate, s.p25) == (3, 0, 0.0, None) and enrich.boundary_statistics(df.limit(0), "p").first().rate is None
    assert [r.fused for r in enrich.fused(df, "q", "p").orderBy("q").collect()] == [0.0, 0.5, 1.0]


def test_prepared_text(spark):
    df = spark.createDataFrame([("hi", list("abcde")), (None, None), ("  ", []), ("x" * 900, ["a"])], "c string, e array<string>")
    got = [r.t for r in df.select(enrich.prepared_text(F.col("c"), F.col("e")).alias("t")).collect()]
    assert got == ["hi [a, b, c, d]", ".", ".", "x" * 256]


def test_every_artifact_of_the_table_may_belong_to_several_episodes(spark, tmp_path):
    rows = [("art-000000001", ["budget"], "E1"), ("art-000000002", [" Budget ", None], "E2"), ("art-000000050", ["visa"], "E3"), ("art-000000051", None, "E3"), ("x", ["budget", "visa"], None)]
    df = spark.createDataFrame(rows, "artifact_id string, entities array<string>, true_episode_id string")
    df = df.selectExpr("*", "timestamp'2026-04-02' AS recorded_at", "'a' AS author", "'c' AS content", "0.5D AS importance", "'note' AS artifact_type", "'s' AS source")
    df.union(df.limit(2)).write.parquet(str(tmp_path / "artifacts.parquet"))
    got = sorted(tuple(r) for r in further.QUERIES["multi_episode_artifacts"](spark, str(tmp_path)).collect())
    assert got == [("art-000000001", "E1", 1.0), ("art-000000001", "E2", 1.0), ("art-000000002", "E1", 1.0), ("art-000000002", "E2", 1.0), ("x", "E1", 0.5), ("x", "E2", 0.5), ("x", "E3", 0.5)]


def _joined_rows(plan) -> int:
    """Rows that came out of all joins of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().get("numOutputRows").get().value() if "Join" in kind else 0) + sum(map(_joined_rows, below))


def test_equal_sets_of_entities_meet_the_edges_once(spark):
    edges = spark.createDataFrame([(f"E{i:03d}", e, 1.0) for i in range(200) for e in ("budget", "visa") + (("lost", "found", "clinic") if i > 1 else ())], "episode string, entity string, weight double")
    rows = [(f"A{i:03d}", ["visa", "budget"] if i % 2 else ["Budget ", " visa", None, "visa"]) for i in range(200)] + [("none", None), ("blank", [" "]), ("other", ["unheard"])]
    df = enrich.shared_by_several(edges, spark.createDataFrame(rows, "artifact_id string, entities array<string>"))
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(f"A{i:03d}", f"E{k:03d}", 1.0) for i in range(200) for k in (0, 1)]
    assert _joined_rows(df._jdf.queryExecution().executedPlan()) < 5_000  # 200 times 400 shared ones otherwise
