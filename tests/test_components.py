import random

from mnesis.operators.components import connected_components


def test_chains_loops_and_repeats(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "x"), ("a", "b"), ("b", "a"), ("c", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got["n040"] == "n000" and got["x"] == "x" and got["b"] == "a" and "c" not in got


def test_random_graphs_agree_with_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
