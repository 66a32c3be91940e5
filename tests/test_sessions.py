import datetime as dt
import random

from mnesis.operators.sessions import GAP_US, sessionize

SCHEMA = "conversation_id string, sent_at timestamp, start_us bigint, n_events string"


def run(spark, rows):
    out = sessionize(spark.createDataFrame(rows, SCHEMA), "conversation_id", "sent_at").collect()
    return sorted((r.conversation_id, r.start_us, r.end_us, r.duration_us, r.n_events) for r in out)


def us(t):
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + t.microsecond


def test_exact_gap_continues_and_more_splits(spark, at):
    rows = [("a", at(8), 1, "x"), ("a", at(8, 30), 1, "x"), ("a", at(9, 0, 1), None, None), ("b", at(8, 10), 1, "x")]
    got = run(spark, rows)
    assert [(g[0], g[4]) for g in got] == [("a", 2), ("a", 1), ("b", 1)]
    assert got[0][1:4] == (us(at(8)), us(at(8, 30)), GAP_US)


def test_nulls_ties_repeats_and_clashing_columns(spark, at):
    rows = [(None, at(8), 1, "x"), ("a", None, 1, "x"), ("a", at(8), 1, "x"), ("a", at(8), 1, "x"), ("a", at(8), None, None)]
    assert [(g[0], g[3], g[4]) for g in run(spark, rows)] == [("a", 0, 3)]


def test_empty_and_times_before_1970(spark):
    assert run(spark, []) == []
    before = [("a", dt.datetime(1969, 12, 31, 23, 50), 1, ""), ("a", dt.datetime(1970, 1, 1, 0, 15), 1, ""), ("a", dt.datetime(1970, 1, 1, 0, 46), 1, "")]
    assert [g[4] for g in run(spark, before)] == [2, 1]


def test_agrees_with_brute_force_in_any_order(spark):
    rng = random.Random(3)
    base = dt.datetime(2026, 1, 1)
    rows = [(f"c{min(rng.randrange(9), 3)}", base + dt.timedelta(seconds=rng.randrange(0, 400_000)), 0, "") for _ in range(1500)]
    want = []
    for c in {r[0] for r in rows}:
        times = sorted(us(r[1]) for r in rows if r[0] == c)
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > GAP_US:
                want.append((c, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((c, start, last, last - start, n))
    rng.shuffle(rows)
    assert run(spark, rows) == sorted(want)
