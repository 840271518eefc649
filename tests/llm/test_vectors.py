import numpy as np
from pyspark.sql import functions as F

from webloom.llm.vectors import nearest_neighbours

SCHEMA = "id long, model string, embedding array<float>"


def brute(rows, k=5, least=0.85):
    out = {}
    usable = [(i, m, np.array(v, dtype=float)) for i, m, v in rows if v and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v)]
    for i, m, v in usable:
        sims = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, n, w in usable if j != i and n == m and len(w) == len(v))
        out[i] = [j for s, j in sims if -s >= least][:k]
    return {i: n for i, n in out.items() if n}


def got(df, **kw):
    out = {}
    for r in sorted(nearest_neighbours(df, **kw).collect(), key=lambda r: (r.id, -round(r.sim, 6), r.neighbour)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def clusters(n, groups, dim, noise, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, dim))
    return [(i, "m", [float(y) for y in v]) for i, v in enumerate(x)]


def test_recall_against_brute_force(spark):
    rows = clusters(3000, 600, 64, 0.25)
    want, have = brute(rows), got(spark.createDataFrame(rows, SCHEMA))
    pairs = {(i, j) for i, n in want.items() for j in n}
    found = {(i, j) for i, n in have.items() for j in n}
    assert len(pairs & found) >= 0.97 * len(pairs) and len(found - pairs) <= 0.03 * len(pairs)


def test_dense_list_is_cut_into_blocks(spark):
    rows = clusters(400, 1, 16, 0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    sets = lambda x: {i: set(n) for i, n in x.items()}
    assert sets(got(df, block=32)) == sets(got(df)) == sets(brute(rows))


def test_the_exact_way(spark):
    rows = clusters(600, 300, 8, 0.8, seed=3)
    have = got(spark.createDataFrame(rows, SCHEMA), least=0.3, gap=2, sigmas=float("inf"), most_lists=7)
    want = brute(rows, least=0.3)
    assert {i: set(n) for i, n in have.items()} == {i: set(n) for i, n in want.items()}


def test_dirty_vectors_copies_and_empty(spark):
    rows = [(i, "m", [1.0, 2.0, 3.0]) for i in range(1, 10)] + [(20, "m", [2.0, 4.0, 6.1]), (21, None, [1.0, 2.0, 3.0]), (22, None, [1.0, 2.0, 3.1])]
    rows += [(30, "m", None), (31, "m", [0.0, 0.0, 0.0]), (32, "m", [float("nan"), 1.0, 1.0]), (33, "m", [1.0, None, 1.0]), (34, "m", []), (35, "m", [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit("clash")).withColumn("rank", F.lit(1))
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == {} == got(df.where("id >= 30 and id < 35"))
