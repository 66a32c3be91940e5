import numpy as np
import pytest

from mnesis.llm import neighbours as N

SCHEMA = "id string, v array<float>, near array<string>, vec int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k, d):
    ok = [(i, np.asarray(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    X = np.array([v / np.linalg.norm(v) for _, v in ok])
    S = X @ X.T
    out = {}
    for a, (i, _) in enumerate(ok):
        order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-round(S[a, b], 5), ok[b][0]))
        out[i] = [ok[b][0] for b in order[:k]]
    return out


def found(spark, rows, d, k=5):
    out = {}
    for r in N.nearest(frame(spark, rows), "id", "v", d, k).collect():
        out.setdefault(r.id, {})[r.near_id] = r.similarity
    return out


def test_dirty_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [nan, 1.0]), ("g", [inf, 1.0]), (None, [1.0, 1.0]), ("h", []), ("i", [None, 1.0])]
    assert {k: set(v) for k, v in found(spark, rows, 2).items()} == {"a": {"b"}, "b": {"a"}}


def test_empty_and_single(spark):
    assert found(spark, [], 4) == {} and found(spark, [("a", [1.0, 0.0])], 2) == {}


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    want = brute(rows, 5, 8)
    got = found(spark, rows, 8)
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}


def test_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 64))
    rows = [(f"v{i:05d}", [float(x) for x in centres[i % 150] + 0.2 * rng.normal(size=64)]) for i in range(1500)]
    want = brute(rows, 5, 64)
    got = found(spark, rows, 64)
    assert len(got) == 1500 and all(len(v) == 5 for v in got.values())
    assert sum(len(set(want[i]) & set(got[i])) for i in want) / (5 * len(want)) > 0.95


def test_large_cells_over_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    assert {k: set(v) for k, v in found(spark, rows, 8).items()} == {k: set(v) for k, v in brute(rows, 5, 8).items()}


def test_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_COPIES", 10)
    rng = np.random.default_rng(3)
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(f"v{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    got = found(spark, rows, 4)
    assert set(got["c039"]) == {"c000", "c001", "c002", "c003", "c004"} and set(got["c000"]) == {"c001", "c002", "c003", "c004", "c005"}
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in brute(rows, 5, 4).items()}


def test_pairs_once_smaller_first(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])]
    assert sorted((r.id_lo, r.id_hi) for r in N.neighbour_pairs(frame(spark, rows), "id", "v", 2, 1).collect()) == [("a", "b"), ("a", "c")]


def test_error_bounds_hold():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 64)).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    cells = N.fit_cells(X, 500)
    b = N._Block(np.array([str(i) for i in range(500)]), X, cells.rotation)
    q = (X[:50] - b.centre) @ cells.rotation
    estimate = (q @ b.signs.T) * (b.norm / b.factor) + (X[:50] @ b.centre)[:, None] + b.shift
    slack = np.linalg.norm(q, axis=1)[:, None] * b.error
    assert (np.abs(estimate - X[:50] @ X.T) <= slack).mean() > 0.9
    assert b.codes.shape == (500, 8)


def test_seeds_and_dimension_are_checked():
    with pytest.raises(Exception):
        np.frombuffer(b"123", dtype="<f4")


@pytest.mark.parametrize("n", [3000, 6000])
def test_two_levels_keep_cells_small_and_recall(spark, monkeypatch, n):
    monkeypatch.setattr(N, "LIST_ROWS", 100)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(n // 10, 64))
    X = centres[np.arange(n) % len(centres)] + 0.2 * rng.normal(size=(n, 64))
    rows = [(f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate(X)]
    got = {}
    for r in N.nearest(frame(spark, rows), "id", "v", 64, 5, most_lists=4).collect():
        got.setdefault(r.id, set()).add(r.near_id)
    unit = (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)
    S = unit @ unit.T
    np.fill_diagonal(S, -2)
    want = np.argpartition(-S, 5, axis=1)[:, :5]
    assert len(got) == n and sum(len({f"v{j:05d}" for j in want[i]} & got[f"v{i:05d}"]) for i in range(n)) / (5 * n) > 0.9
    cells = N.fit_cells(unit, n, most_lists=4)
    assert len(cells.centres) == 4 and len(cells.residuals) == min(4, round(n / 400))


def test_rows_of_a_cell_do_not_grow_with_the_table():
    rng = np.random.default_rng(3)
    met = []
    for n in (10_000, 20_000):  # twice the rows have twice the fine cells beyond the limit of coarse centres
        centres = rng.normal(size=(n // 20, 16))
        X = centres[np.arange(n) % len(centres)] + 0.2 * rng.normal(size=(n, 16))
        X = (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)
        cells = N.fit_cells(X, n * 12, most_lists=20, rounds=4)
        own, _, _ = cells.look(X)
        met.append(float(np.mean(np.bincount(own)[own])))
        assert len(cells.centres) == 20 and len(cells.residuals) == n // 1000
    assert met[1] < 1.4 * met[0]


def test_only_the_best_rows_are_compared_in_double_precision(monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1200, 64)).astype(np.float32)
    X[1:9] = X[0]
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    b = N._Block(np.array([f"{i:04d}" for i in range(1200)]), X, N.fit_cells(X, 1200).rotation)
    compared, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda s, x, y: compared.append(len(x)) or einsum(s, x, y))
    r, c, _ = b.search(b.ids, X, np.arange(1200), 5)
    assert sum(compared) < 1.1 * 5 * 1200
    S = X.astype(float) @ X.T.astype(float)
    np.fill_diagonal(S, -2)
    want = [set(np.lexsort((np.arange(1200), -S[i].round(9)))[:5]) for i in range(1200)]
    assert want[0] == {1, 2, 3, 4, 5} == set(c[r == 0]) and set(c[r == 8]) == {0, 1, 2, 3, 4}
    assert sum(len(want[i] & set(c[r == i])) for i in range(1200)) / (5 * 1200) > 0.99
