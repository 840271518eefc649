import random

from webloom.operators.components import connected_components


def brute(edges):
    at = {}
    for a, b in edges:
        at.setdefault(a, a), at.setdefault(b, b)
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


def got(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_random_chain_star(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 600 + i) for i in range(30)] + [(900, 900)]
    assert got(spark, edges + edges[:5]) == brute(edges)


def test_empty_and_nulls(spark):
    assert got(spark, [(None, 1), (2, None)]) == {}
