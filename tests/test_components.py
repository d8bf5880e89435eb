import random

from heliograph.operators.components import connected_components


def truth(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "x long, y long")
    return {r["node"]: r["component"] for r in connected_components(df).collect()}


def test_random_graphs_and_long_path(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(150)]
    edges += [(2000, 3000 + i) for i in range(100)]
    assert run(spark, edges) == truth(edges)


def test_nulls_loops_and_empty(spark):
    assert run(spark, [(None, 1), (2, 2), (5, 4), (4, 5)]) == {2: 2, 4: 4, 5: 4}
    assert run(spark, []) == {}
