import datetime as dt
import random

import pytest

from mnesis.llm.runs import canonical, collapse_runs, same_event

SCHEMA = "artifact_id string, recorded_at timestamp, author string, content string, us bigint, pid int, first_id string"
T = dt.datetime(2026, 4, 2)


def run(spark, rows, partitions=3):
    data = [(i, T + dt.timedelta(seconds=s) if s is not None else None, a, c, 1, 1, "x") for i, s, a, c in rows]
    out = collapse_runs(spark.createDataFrame(data, SCHEMA), partitions).collect()
    return sorted((r.first_id, r.last_id, r.n_events, r.duration_us // 1_000_000) for r in out)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Sync of the folder failed", "sync  of the folder failed!!", True), ("Scan prêt", "> Scan pret…", True), ("[07:00] Waiting for X", "[07:07] Waiting for X", True), ("upload pending, essai 2", "upload pending, essai 3", True),
        ("upload pending #2", "upload pending (attempt 3)", True), ("Re: upload of it pending", "upload of it pending 🙏", True), ("Uplaod of Fernwick pending", "Upload of Fernwic pending", True), ("On the whole", "O the whole", True),
        ("Invoice 2025-1 was paid", "Invoice 2025-2 was paid", False), ("Réunion du 2 mars", "Réunion du 3 mars", False), ("meet at 7h05 there", "meet at 7h06 there", False), ("meet on Monday please", "meet on Sunday please", False),
        ("Train to Valmoret booked", "Train to Fernwick booked", False), ("file complete", "file no longer complete", False), ("room 12", "room 21", False), ("😂", "😂😂", False), ("😂", "😂", True), ("Tuesday at the desk", "Thursday at the desk", False),
    ],
)
def test_same_event(a, b, same):
    assert same_event(canonical(a), canonical(b)) is same


def test_runs_breaks_and_ties(spark):
    rows = [("a1", 0, "u", "ping it"), ("a3", 5, "u", "ping it!"), ("a2", 5, "u", "Ping it"), ("a4", 6, "u", None), ("a5", 7, "u", "ping it"), ("a6", 8, "u", " "), ("a7", 9, "u", "pong"), ("b1", 0, "v", "pong"), ("b2", 999, "v", "pong")]
    assert run(spark, rows) == [("a1", "a3", 3, 5), ("b1", "b2", 2, 999)]


def test_repeated_exports_nulls_and_empty(spark):
    rows = [("a1", 0, "u", "ping it")] * 3 + [("a2", None, "u", "ping it"), ("a3", 3, None, "ping it"), (None, 4, "u", "ping it")]
    assert run(spark, rows) == [] and run(spark, []) == []


def test_awkward_long_texts_take_linear_time():
    assert canonical("a" + " " * 200_000 + "b" + "!" * 100_000) == ("a", "b")
    assert canonical("a " + ". " * 100_000 + "b") == ("a", "b")
    assert canonical(">" * 100_000 + " a b") == ("a", "b")


def test_long_texts(spark):
    long = "word " * 30_000
    assert run(spark, [("a", 0, "u", long + "1"), ("b", 1, "u", long + "1"), ("c", 2, "u", long + "2")]) == [("a", "b", 2, 1)]


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_hot_author_over_many_tasks_agrees_with_brute_force(spark, partitions):
    rng = random.Random(1)
    rows = [(f"a{i:04d}", i, "hot" if i % 3 else f"u{i % 5}", rng.choice(["alpha beta", "gamma delta", None])) for i in range(600)]
    want = []
    for author in {r[2] for r in rows}:
        run_ = []
        for r in [x for x in rows if x[2] == author] + [(None, 0, author, None)]:
            if run_ and r[3] is not None and r[3] == run_[-1][3]:
                run_.append(r)
                continue
            if len(run_) > 1:
                want.append((run_[0][0], run_[-1][0], len(run_), run_[-1][1] - run_[0][1]))
            run_ = [r] if r[3] is not None else []
    assert run(spark, rows, partitions) == sorted(want)
