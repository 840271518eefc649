import random

from pyspark.sql import functions as F

from webloom.operators.hierarchy import descendants, hierarchy, latest_links

SCHEMA = "tree string, node long, parent long"


def brute(rows):
    parent = {(t, n): p for t, n, p in rows}
    up = {}
    for (t, n) in parent:
        chain, at, seen = [], n, set()
        while (t, at) in parent and at not in seen:
            seen.add(at)
            chain.append(at)
            at = parent[t, at] if (t, parent[t, at]) in parent else None
        up[t, n] = (chain, at)
    out = {}
    for (t, n), (chain, stop) in up.items():
        below = sum(1 for (s, m), (c, _) in up.items() if s == t and m != n and n in c)
        if stop is None:
            out[t, n] = (chain[-1], len(chain) - 1, below)
        else:
            loop = chain[chain.index(stop):]
            out[t, n] = (min(loop), -1 if n in loop else -2, below)
    return out


def as_dict(df):
    return {(r.tree, r.node): (r.root, r.hops, r.n_below) for r in df.collect()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    rows = [(t, n, rng.choice([None, 999, *range(25)])) for t in "ab" for n in range(25)]
    rows += [("chain", n, n - 1) for n in range(70)] + [("ring", n, (n + 1) % 6) for n in range(6)]
    rows += [("ring", n, n - 1) for n in range(6, 20)] + [("self", 1, 1), ("self", 2, 1)]
    assert as_dict(hierarchy(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_paths_and_descendants(spark):
    rows = [("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 4, 2), ("b", 9, 8), ("c", 5, 5)]
    out = hierarchy(spark.createDataFrame(rows, SCHEMA), with_path=True)
    assert {(r.tree, r.node): r.path for r in out.collect()}["a", 4] == [1, 2, 4]
    assert {(r.tree, r.node): r.path for r in out.collect()}["c", 5] is None
    pairs = {(r.ancestor, r.node, r.distance) for r in descendants(out).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (2, 4, 1)}


def test_empty_nulls_ties_and_extra_columns(spark):
    raw = spark.createDataFrame(
        [("r", 1, None, None, 1, "x"), ("r", 1, 2, 5, 2, "x"), ("r", 1, 2, 5, 2, "x"), ("r", 2, 7, None, 3, None), (None, 3, 1, 1, 4, "x"), ("r", None, 1, 1, 5, "x"), ("r", 2, None, None, 9, "y")],
        "run_id string, url_id long, parent_id long, updated_at long, id long, best string",
    )
    links = latest_links(raw, "run_id", "url_id", "parent_id", "updated_at", "id")
    assert {(r.node, r.parent) for r in links.collect()} == {(1, 2), (2, None)}
    assert as_dict(hierarchy(links.withColumn("root", F.lit("clash")))) == {("r", 1): (2, 1, 0), ("r", 2): (2, 0, 1)}
    assert hierarchy(links.limit(0)).count() == 0
