import numpy as np
import pytest

from mnesis.llm.packing import pack, pack_documents, sum_of_squares, token_counts


def brute_sum_of_squares(sizes, capacity):
    level, fills = [0] * (capacity + 1), []
    out = []
    for s in sizes:
        options = []
        for h in {0, *[f for f in fills if f + s <= capacity]}:
            if h + s > capacity:
                continue
            new = list(level)
            if h:
                new[h] -= 1
            if h + s < capacity:
                new[h + s] += 1
            options.append((sum(x * x for x in new), -h, h))
        h = min(options)[2]
        if h:
            fills.remove(h)
            level[h] -= 1
        if h + s < capacity:
            fills.append(h + s)
            level[h + s] += 1
        out.append(h)
    return out


def test_agrees_with_brute_force():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 20, 300)
    bins, offsets = sum_of_squares(sizes, 20)
    assert list(offsets) == brute_sum_of_squares(list(sizes), 20)


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), "x", 1) for i, n in enumerate(rng.integers(1, 1500, 1000))] + [(5000, 5000, "x", 1), (5001, 0, "x", 1), (5002, None, "x", 1), (5003, 2048, "x", 1), (7, 10, "x", 1), (5004, -3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container string, block int")
    return rows, pack(df, block_items=400).toPandas()


def test_every_item_once_and_no_overflow(packed):
    rows, p = packed
    want = {}
    for i, n, *_ in rows:
        want[i] = want.get(i, 0) + max(n or 0, 0)
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == want
    placed = p[p.container_id.notna()].sort_values(["container_id", "start_at"])
    assert placed.groupby("container_id").n_tokens.sum().max() <= 2048
    ends = placed.start_at + placed.n_tokens
    same = placed.container_id.shift(-1) == placed.container_id
    assert (ends[same] <= placed.start_at.shift(-1)[same]).all()
    assert len(p[p.doc_id == 5000]) == 3 and (p[(p.n_tokens < 2048) & (p.doc_id != 5000)].piece_no == 1).all()
    assert p[p.n_tokens == 0].container_id.isna().all() and set(p[p.n_tokens == 0].doc_id) == {5001, 5002, 5004}


def test_little_space_is_lost(packed):
    _, p = packed
    assert p.container_id.nunique() <= 1.08 * p.n_tokens.sum() / 2048 + 4


def test_whole_texts_are_counted(spark):
    docs = spark.createDataFrame([(1, "hello world", 3), (2, None, 3), (3, "", 3), (4, "word " * 40_000, 3)], "doc_id bigint, text string, n_tokens int")
    n = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert n[2] == n[3] == 0 and n[1] in (2, 3) and n[4] >= 40_000
    assert pack_documents(docs).where("doc_id = 4").count() == -(-n[4] // 2048)
    assert pack_documents(docs.limit(0)).count() == 0
