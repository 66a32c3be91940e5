"""Relational and sequential operators on small hand-made frames."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.functions import scores, sets, text, times, vectors
from mnesis.operators import features, graph, lifecycle, metrics, recall, segment, summarise
from mnesis.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert one(spark, vectors.cosine(vec(1, 0), vec(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(vec(0, 0), vec(1, 1))) == 0 and one(spark, vectors.cosine(vec(1), vec(1, 1))) == 0
    assert one(spark, vectors.dual_cosine(vec(1, 0), vec(-1, 0), vec(0, 1))) == 0
    assert one(spark, vectors.ema_step(vec(1, 1), vec(2, 0), 0.8)) == pytest.approx([1.8, 0.2])
    assert one(spark, vectors.ema_vector(F.array(vec(1, 1), vec(2, 0)), 0.8)) == pytest.approx([1.8, 0.2])
    e = one(spark, vectors.hashing_embedding(F.lit("budget meeting budget"), 16))
    assert len(e) == 16 and sum(x * x for x in e) == pytest.approx(1)
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [0.0, 1.0], 1)], "g int, v array<float>, n int")
    r = df.groupBy("g").agg(vectors.mean_vector("v", 2).alias("m"), vectors.weighted_mean_vector("v", "n", 2).alias("w")).collect()[0]
    assert r.m == [0.5, 0.5] and r.w == [0.75, 0.25]


def test_scores(spark):
    assert one(spark, scores.half_life_recency(F.lit(168.0))) == 0.5
    assert one(spark, scores.age_penalty(F.lit(25.0), F.lit("ACTIVE"))) == pytest.approx(0.3 * math.log(2))
    assert one(spark, scores.age_penalty(F.lit(-1.0), F.lit("DORMANT"))) == 0
    assert sum(one(spark, scores.softmax(vec(1, 2, 3)))) == pytest.approx(1)
    assert one(spark, scores.axis_scores(vec(1, 2, 3, 4, 5, 6, 9, 8, 7))) == (3, 6, 9)
    assert one(spark, scores.creation_threshold(0.3, 0.1, F.lit(30))) == pytest.approx(0.2)


def test_sets(spark):
    m = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(float(v)))])
    assert one(spark, sets.weighted_jaccard(m(a=1, b=1), m(a=3))) == pytest.approx(4 / 5)
    assert one(spark, sets.precision_overlap(F.array(F.lit("a"), F.lit("z")), m(a=2, b=4))) == pytest.approx(2 / 8)
    assert one(spark, sets.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, sets.top_keys(m(a=1, c=2, b=2), 2)) == ["b", "c"]
    assert one(spark, sets.merge_weights_scaled(m(a=1), m(a=3, b=2), F.lit(3), F.lit(1))) == {"a": 3, "b": 0.5}
    assert one(spark, sets.tidy_entities(F.array(F.lit(" A"), F.lit("a"), F.lit(" "), F.lit(None)))) == ["a"]


def test_text(spark):
    noise = {"ok!!": True, "😂😂": True, "https://a.b/c": True, "budget meeting": False, "привет": True, "oooooh": True, "merci ": True, "abc": True, "": True}
    for s, want in noise.items():
        assert one(spark, text.is_noise(F.lit(s))) is want, s
    assert one(spark, text.is_noise(F.lit(None).cast("string"))) is True
    keep = {"Marie Curie": True, "la maison": False, "x9f": False, "12": False, "heyyy": False, "un deux trois quatre cinq": False, "oh": False, "bcdfg": False}
    for s, want in keep.items():
        assert one(spark, text.is_structural_entity(F.lit(s))) is want, s
    assert one(spark, text.mood(F.lit("love and happy"))) == "positive" and one(spark, text.mood(F.lit("xyz"))) == "neutral"
    assert one(spark, text.extract(F.lit("call 06 39 98 10 22 on 20240101"), "PHONE")) == ["06 39 98 10"]
    assert one(spark, text.boundary_probability(F.lit('x {"boundary": false, "confidence": 0.9}'))) == pytest.approx(0.1)
    df = spark.createDataFrame([("data science lab", "data science")], "a string, b string")
    assert df.select(text.string_similarity(F.col("a"), F.col("b")).alias("x")).collect()[0].x == pytest.approx(0.857142, abs=1e-5)


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, times.time_label(ts("2026-02-01 08:05:00"), ts("2026-02-01 08:06:00"))) == "dim 1 fév à 08h05"
    assert one(spark, times.time_label(ts("2026-02-01 13:05:00"), ts("2026-02-01 18:06:00"))) == "Midi du dim 1 fév"
    assert one(spark, times.time_label(ts("2026-01-30 13:05:00"), ts("2026-02-05 18:06:00"))) == "30 jan – 5 fév"
    assert one(spark, times.age_label(F.lit(8.0))) == "il y a 1 semaines" and one(spark, times.age_label(F.lit(0.5))) == "aujourd'hui"


def test_bursts_and_depths(spark):
    rows = [("c", "a", i * 10_000_000, i, f"word number {i}") for i in range(7)] + [("c", "b", 70_000_000, 9, "ok")]
    b = features.bursts(spark.createDataFrame(rows, "s string, a string, us bigint, id int, t string"), "s", "a", "us", "id", "t").orderBy("start_us").collect()
    assert [x.n for x in b] == [5, 2, 1] and b[2].content == "" and b[1].content == "word number 5 | word number 6"
    s = [3.0, 1.0, 2.0, 5.0, 4.0]
    d = features.depth_scores(spark.createDataFrame([("x", i, v) for i, v in enumerate(s)], "s string, o int, v double"), "s", "o", "v").orderBy("o").collect()
    assert [x.depth for x in d] == [0.0, 3.0, 1.5, 0.0, 0.5]


def test_metrics(spark):
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), (None, 3)], "t string, p int")
    r = metrics.agreement(same, "t", "p").collect()[0]
    assert (r.n, r.ari, r.nmi, r.fragmentation) == (4, 1.0, pytest.approx(1.0), 1.0)
    one_cluster = metrics.agreement(same.withColumn("p", F.lit(1)).withColumn("t", F.lit("a")), "t", "p").collect()[0]
    assert one_cluster.ari == 1.0 and one_cluster.nmi == 1.0


def test_graph(spark):
    e = spark.createDataFrame([("E1", "x", 1.0), ("E1", "y", 1.0), ("E2", "x", 3.0), ("E3", "z", 1.0)], "episode string, entity string, weight double")
    r = graph.related(e, spark.createDataFrame([("E1",)], "episode string")).collect()
    assert [(x.other, x.similarity) for x in r] == [("E2", 0.8)]
    assert "penwidth=1.5" in graph.to_dot(e)


def test_recall_ranks_with_ties_and_empty(spark):
    schema = "episode_id string, centroid array<double>, hours_old double, memory double, status string"
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<double>")
    rows = [("b", [1.0, 0.0], 0.0, 1.0, "raw"), ("a", [1.0, 0.0], 0.0, 1.0, "raw"), ("c", None, None, None, "raw"), ("d", [1.0, 0.0], 0.0, 1.0, "archived")]
    got = recall.recall(spark.createDataFrame(rows, schema), q).orderBy("rank").collect()
    assert [(x.episode_id, x.relevance) for x in got] == [("a", 0.8), ("b", 0.8), ("c", 0.0)]
    assert recall.recall(spark.createDataFrame([], schema), q).count() == 0


def test_recall_answers_more_queries_than_a_block(spark, monkeypatch):
    schema = "episode_id string, centroid array<double>, hours_old double, memory double, status string"
    e = spark.createDataFrame([("a", [1.0, 0.0], 5.0, 1.0, "raw"), ("b", [0.0, 1.0], 0.0, 0.5, "raw")], schema)
    q = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(30)], "query_id int, query_vec array<double>")
    want = sorted(recall.recall(e, q).collect())
    monkeypatch.setattr(recall, "BLOCK", 20)
    assert sorted(recall.recall(e, q).collect()) == want and len(want) == 60


def test_lifecycle(spark):
    rows = [("a", "raw", 200.0, 0.0, 0, "x"), ("b", "dormant", 200.0, 0.0, 0, "todo list"), ("c", "raw", None, 0.0, None, None)]
    e = spark.createDataFrame(rows, "episode_id string, status string, days_old double, salience double, access_count int, title string").withColumn("memory", F.col("salience"))
    assert {r.episode_id: r.new_status for r in lifecycle.decay(e).collect()} == {"a": "raw", "b": "archived", "c": "raw"}
    states = [("a", "ACTIVE", 200.0, 0.5, "projet"), ("b", "DORMANT", 200.0, 0.5, "todo list"), ("c", "CONSOLIDATED", 119.9, 0.5, None), ("d", "CONSOLIDATED", 120.0, 0.5, "x"), ("e", "ARCHIVED", 900.0, 0.5, "todo"), ("f", "DORMANT", None, None, None), ("g", "DORMANT", 29.0, 0.5, "x")]
    e = spark.createDataFrame([(*x, [1.0, 0.0]) for x in states], "episode_id string, state string, days_old double, memory double, title string, centroid array<double>")
    actions = lifecycle.decisions(e)
    done = {r.episode_id: (r.state, r.memory, r.centroid) for r in lifecycle.apply_actions(e, actions).collect()}
    assert done["b"] == ("CONSOLIDATED", 0.425, None) and done["d"] == ("ARCHIVED", 0.25, None) and done["a"] == ("ACTIVE", 0.5, [1.0, 0.0]) and done["c"][0] == "CONSOLIDATED"
    acts = {(r.episode_id, r.action) for r in actions.collect()}
    assert acts == {("a", "FLAG"), ("b", "COMPRESS"), ("b", "FLAG"), ("d", "ARCHIVE")}
    surfaced = lifecycle.decisions(e, query_vec=F.array(F.lit(1.0), F.lit(0.1))).where("action = 'SURFACE'")
    assert {r.episode_id for r in surfaced.collect()} == {"a", "b", "g"}


def seq(spark, rows):
    return spark.createDataFrame(rows, "stream string, id string, us bigint, vec array<double>, entities array<string>, boundary double")


def test_time_only_segmentation_equals_islands(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 3}", f"m{i}", int(t), None, None, None) for i, t in enumerate(rng.integers(0, 4 * 86400, 400) * 1_000_000)]
    cfg = segment.temporal_only()
    got = segment.segment(seq(spark, rows), cfg).groupBy("stream", "session", "episode_no").agg(F.min("us"), F.max("us"), F.count(F.lit(1))).count()
    gap = -math.log(0.30) * 120 / 2.3
    assert got == features.islands(seq(spark, rows), "stream", "us", "id", gap).select("stream", "island").distinct().count()


def test_segmentation_resumes_interrupted_topics(spark):
    m = 60_000_000
    rows = [("s", "1", 0, [1.0, 0.0], ["x"], None), ("s", "2", 1 * m, [0.0, 1.0], ["y"], None), ("s", "3", 100 * m, [1.0, 0.0], ["x"], None), ("s", "4", 2000 * m, [1.0, 0.0], None, None)]
    cfg = segment.SegmentConfig(threshold=0.5)
    got = {r.id: (r.session, r.episode_no) for r in segment.segment(seq(spark, rows), cfg).collect()}
    assert got["1"] == got["3"] != got["2"] and got["4"] == (1, 3)


def test_break_holds_for_the_best_candidate_only(spark):
    m = 60_000_000
    rows = [("s", "1", 0, [1.0, 0.1], ["x"], None), ("s", "2", 660 * m, [0.0, 1.0], ["y"], None), ("s", "3", 790 * m, [1.0, 0.2], ["x"], None)]
    at = lambda b: {r.id: r.episode_no for r in segment.segment(seq(spark, rows), segment.SegmentConfig(hard_break_minutes=b)).collect()}
    assert at(720) == {"1": 1, "2": 2, "3": 3} and at(None) == {"1": 1, "2": 2, "3": 1}


def plain_segmentation(rows, cfg):
    """The rules word for word: all episodes looked at for every row."""
    episodes, out = [], {}
    cos = lambda a, b: max(0.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))) if a is not None and b is not None and np.any(a) and np.any(b) else 0.0
    for _, key, us, vec, names, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        names = names or []
        for e in episodes:
            if e["state"] == "ACTIVE" and us - e["end"] > cfg.dormancy_minutes * 60e6:
                e["state"] = "DORMANT"
        best, best_score = None, -1.0
        for e in episodes:
            if e["state"] == "DORMANT" and not cfg.reactivate or not (e["end"] >= us - cfg.recent_minutes * 60e6 or set(names) & set(e["w"])):
                continue
            gap, hours = abs(us - e["end"]) / 60e6, max(0, us - e["end"]) / 3.6e9
            ent = sum(e["w"][k] for k in set(names) & set(e["w"])) / (len(set(names)) * max(e["w"].values())) if set(names) & set(e["w"]) else 0.0
            age = math.log1p(hours) if e["state"] == "DORMANT" else 0.3 * math.log1p(hours - cfg.active_hours) if hours > cfg.active_hours else 0.0
            score = max(0.0, cfg.semantic * cos(vec, e["c"]) + cfg.entity * ent + cfg.temporal * math.exp(-2.3 / cfg.time_minutes * gap) - cfg.age * age)
            if score > best_score + 1e-12:
                best, best_score = e, score
        if best is not None and cfg.hard_break_minutes and us - best["end"] > cfg.hard_break_minutes * 60e6:
            best = None
        active = sum(e["state"] == "ACTIVE" for e in episodes)
        if best is not None and best_score >= cfg.threshold - cfg.novelty * min(active / cfg.novelty_episodes, 1.0):
            if vec is not None:
                best["c"] = np.array(vec) if best["c"] is None else (1 - cfg.ema) * best["c"] + cfg.ema * np.array(vec)
            best["end"], best["state"] = max(best["end"], us), "ACTIVE"
            for k in names:
                best["w"][k] = best["w"].get(k, 0) + 1.0
        else:
            best = {"no": len(episodes) + 1, "end": us, "c": np.array(vec) if vec is not None else None, "w": {k: 1.0 for k in names}, "state": "ACTIVE"}
            episodes.append(best)
        out[key] = best["no"]
    return out


@pytest.mark.parametrize("change", [{}, {"hard_break_minutes": 720}, {"hard_break_minutes": 300, "reactivate": False}, {"novelty": 0.1, "dormancy_minutes": 600}, {"threshold": 0.55, "recent_minutes": 100}])
def test_segmentation_agrees_with_the_plain_rules(spark, change):
    rng = np.random.default_rng(5)
    rows = []
    for i, t in enumerate(np.cumsum(rng.exponential(90, 250))):
        names = [str(x) for x in rng.choice(list("abcdefgh"), rng.integers(0, 3))]
        vec = [float(x) for x in rng.normal(size=4)] if i % 9 else None
        rows.append(("s", f"m{i:03d}", int(t * 60e6) // 7 * 7, vec, names if i % 5 else None, None))
    cfg = segment.SegmentConfig(**change)
    assert {r.id: r.episode_no for r in segment.segment(seq(spark, rows), cfg).collect()} == plain_segmentation(rows, cfg)
    bare = [(*r[:4], None, None) for r in rows]  # without entities streams may be cut
    got, want = {r.id: (r.session, r.episode_no) for r in segment.segment(seq(spark, bare), cfg).collect()}, plain_segmentation(bare, cfg)
    assert len({(got[k], want[k]) for k in want}) == len(set(got.values())) == len(set(want.values()))


def test_merge_split_and_reassign(spark):
    m = 60_000_000
    eps = [("s", 1, 0, 10 * m, 5, [1.0, 0.0]), ("s", 2, 20 * m, 21 * m, 1, [1.0, 0.1]), ("s", 3, 30 * m, 31 * m, 1, [0.0, 1.0]), ("s", 4, 500 * m, 501 * m, 1, [0.0, 1.0])]
    got = {r.episode_no: r.merged_no for r in segment.merge_small(spark.createDataFrame(eps, "stream string, episode_no bigint, start_us bigint, end_us bigint, n bigint, centroid array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    members = [("E", f"i{i}", i, [1.0, 0.01 * i] if i < 6 else [0.01 * i, -1.0]) for i in range(12)] + [("F", "z", 1, None)]
    parts = {(r.episode, r.id): r.part for r in segment.split_large(spark.createDataFrame(members, "episode string, id string, us bigint, vec array<double>")).collect()}
    assert len({parts["E", f"i{i}"] for i in range(6)}) == 1 and parts["E", "i0"] != parts["E", "i11"] and parts["F", "z"] == 0
    rows = spark.createDataFrame([("s", str(i), i * m, v, ["k"]) for i, v in enumerate([[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 4)], "stream string, id string, us bigint, vec array<double>, entities array<string>")
    start = spark.createDataFrame([("s", str(i), "A" if i < 5 else "B") for i in range(8)], "stream string, id string, episode string")
    moved = {r.id: r.episode for r in segment.reassign(rows, start, 2).collect()}
    assert moved["4"] == "B" and moved["0"] == "A"


def test_split_clusters_episodes_of_any_size_whole(spark):
    rng = np.random.default_rng(2)
    near = lambda v: [float(x) for x in np.asarray(v) + 0.01 * rng.normal(size=4)]
    one_topic = [("hot", f"h{i}", i, near([1, 0, 0, 0])) for i in range(1700)]
    two_topics = [("mixed", f"m{i}", i, near([1, 0, 0, 0] if i % 2 else [0, 1, 0, 0])) for i in range(3300)]
    spread = lambda v: [float(x) for x in v]
    noise = [("noise", f"n{i}", i, spread(rng.normal(size=64))) for i in range(1600)]
    got = segment.split_large(spark.createDataFrame(one_topic + two_topics + noise, "episode string, id string, us bigint, vec array<double>")).collect()
    parts = {(r.episode, r.id): r.part for r in got}
    assert len(got) == 6600 and {p for (e, _), p in parts.items() if e == "noise"} == {0}
    assert {parts["mixed", f"m{i}"] for i in range(0, 3300, 2)} == {1} and {parts["mixed", f"m{i}"] for i in range(1, 3300, 2)} == {2}
    assert len({p for (e, _), p in parts.items() if e == "hot"}) == 1


def test_average_linkage_and_silhouette_equal_pairwise_distances():
    rng = np.random.default_rng(3)
    for n in (8, 30, 60):
        x = rng.normal(size=(n, 5)) + 3 * rng.normal(size=(3, 5))[rng.integers(0, 3, n)]
        x[1] = x[0]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
        np.fill_diagonal(d, 0)
        got, clusters = segment.average_linkage(x, 2, 6), [[i] for i in range(n)]
        while len(clusters) > 1:
            if len(clusters) <= 6:
                assert sorted(map(sorted, clusters)) == sorted(np.flatnonzero(got[len(clusters)] == c).tolist() for c in range(len(clusters)))
            pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j]
            _, i, j = min(pairs)
            clusters[i] += clusters.pop(j)
        s, labels = [], got[3]
        for i in range(n):
            own = np.flatnonzero(labels == labels[i])
            a = d[i, own].sum() / max(len(own) - 1, 1)
            b = min(d[i, labels == c].mean() for c in range(3) if c != labels[i])
            s.append((b - a) / max(a, b) if len(own) > 1 else 0)
        assert segment.silhouette(x, labels) == pytest.approx(np.mean(s))


def test_consolidation_finds_all_pairs_and_merges_groups(spark):
    rng, h = np.random.default_rng(6), 3_600_000_000
    eps = [(f"e{i:02d}", int(s), int(s + rng.integers(0, 40) * h), [float(x) for x in rng.normal(size=2)], int(rng.integers(1, 5))) for i, s in enumerate(rng.integers(0, 300, 90) * h)]
    ents = {e[0]: {"all"} | {f"k{j}" for j in rng.integers(0, 12, rng.integers(0, 5))} for e in eps}
    df = spark.createDataFrame(eps, "episode string, start_us bigint, end_us bigint, centroid array<double>, n int")
    edges = spark.createDataFrame([(e, k) for e, ks in ents.items() for k in ks], "episode string, entity string")
    want, parent = {}, {e[0]: e[0] for e in eps}
    for a, sa, ea, ca, _ in eps:
        for b, sb, eb, cb, _ in eps:
            jac, sim = len(ents[a] & ents[b]) / len(ents[a] | ents[b]), float(np.dot(ca, cb) / np.linalg.norm(ca) / np.linalg.norm(cb))
            if a < b and jac >= 0.3 and sim >= 0.7 and min(abs(sb - ea), abs(sa - eb)) <= 72 * h:
                want[a, b] = pytest.approx(sim + jac, abs=1e-6)
                old, new = parent[b], parent[a]
                parent = {k: new if v == old else v for k, v in parent.items()}
    pairs = segment.consolidation_pairs(df, edges)
    assert {(r.a, r.b): r.score for r in pairs.collect()} == want and len(want) > 20
    base = {}
    for e, s, _, _, n in sorted(eps, key=lambda e: (-e[4], e[1], e[0])):
        base.setdefault(parent[e], e)
    got = {r.episode: r.base for r in segment.consolidate(df, pairs).collect()}
    assert got == {e: base[parent[e]] for e in {x for p in want for x in p}}
    with pytest.raises(ValueError):
        segment.consolidation_pairs(df, edges, least_jaccard=0)


def test_tfidf_and_quotes(spark):
    docs = spark.createDataFrame([(1, "budget budget school"), (2, "school clinic"), (3, None), (4, "")], "k int, t string")
    r = summarise.tfidf_keywords(docs, "k", "t").where("k = 1 and rank = 1").collect()[0]
    assert r.term == "budget"
    quotes = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(t).alias("text")) for s, t in ((0.9, "a b c d"), (0.8, "a b c d"), (0.7, "x y"))])
    assert one(spark, summarise.pick_quotes(quotes)) == ["a b c d", "x y"]
    assert one(spark, summarise.label(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(" "))) == "Conversation générale"


def test_readers(spark, tmp_path):
    chat = tmp_path / "c.txt"
    chat.write_text("2026-02-01, 08 h 05 - Alice: budget meeting tomorrow\ncontinued\n2026-02-01, 08 h 06 - Bob: ok\n")
    rows = readers.read_dataset(spark, str(chat)).collect()
    assert [(r.id, r.author, r.content) for r in rows] == [("1", "Alice", "budget meeting tomorrow"), ("3", "Bob", "ok")]
    csv = tmp_path / "d.csv"
    csv.write_text('artifact_id,timestamp,content,entities,true_episode_id\nA1,2026-02-01 08:05,"hi, you","x, y",E1\nA2,2026-02-01 08:04,yo,,\n')
    rows = readers.read_dataset(spark, str(csv)).collect()
    assert [(r.id, r.entities, r.author, r.importance) for r in rows] == [("A2", [], "unknown", 0.5), ("A1", ["x", "y"], "unknown", 0.5)]
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.pdf")
    dial = tmp_path / "d.json"
    dial.write_text(json.dumps({"dial_data": {"s": [{"dial_id": "d1", "turns": [{"utterance": "a", "topic_id": 1}, {"utterance": "b", "topic_id": 2}]}, {"dial_id": "e", "turns": []}, {"dial_id": "d2", "turns": [{"utterance": "c", "topic_id": 0}]}]}}))
    rows = readers.read_dialogues_json(spark, str(dial)).orderBy("timestamp").collect()
    assert [(r.utterance, r.label) for r in rows] == [("a", "d1__topic_1"), ("b", "d1__topic_2"), ("c", "d2__topic_0")]
    assert rows[2].timestamp - rows[0].timestamp == dt.timedelta(minutes=1442)
    txt = tmp_path / "s.txt"
    txt.write_text("call_id_1\n0 hello\n1 there\ncall_id_2\n0 bye\n")
    assert [r.label for r in readers.read_dialogues_txt(spark, str(txt)).orderBy("timestamp").collect()] == ["call_id_1__topic_0", "call_id_1__topic_1", "call_id_2__topic_0"]


def test_gold_chunks_and_sinks(spark, tmp_path):
    a = spark.range(12).select(F.col("id").alias("artifact_idx"))
    gold = spark.createDataFrame([(1, 0, 3), (2, 3, 5)], "episode_id int, start_idx bigint, end_idx bigint")
    got = [r.gold_episode for r in readers.gold_labels(a, gold).orderBy("artifact_idx").collect()]
    assert got == [1, 1, 1, 2, 2, 2] + [None] * 6
    assert readers.chunks(a, 12, 5, 1).groupBy("chunk_no").count().orderBy("chunk_no").collect()[-1]["count"] == 4
    e = spark.createDataFrame([("a", "raw", None), ("b", "raw", "t")], "episode_id string, status string, title string")
    r = {x.episode_id: (x.status, x.title) for x in writers.enrich(e, spark.createDataFrame([("a", "new")], "episode_id string, title string"), "m", 1).collect()}
    assert r == {"a": ("enriched", "new"), "b": ("raw", "t")}
    up = writers.upsert_latest(spark.createDataFrame([(1, 1, "x")], "k int, o int, v string"), spark.createDataFrame([(1, 2, "y"), (2, 1, "z")], "k int, o int, v string"), "k", "o")
    assert sorted((x.k, x.v) for x in up.collect()) == [(1, "y"), (2, "z")]
    writers.save_store({"episodes": e}, str(tmp_path / "store"))
    assert readers.read_store(spark, str(tmp_path / "store"))["episodes"].count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_store(spark, str(tmp_path / "none"))
