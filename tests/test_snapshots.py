import random

import numpy as np
from pyspark.sql import functions as F

from webloom.functions.titles import shown
from webloom.operators.snapshots import hash_longs, snapshot_changes

SCHEMA = "run_id string, url string, title string, fetched_at long"


def test_hash_matches_sql(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(50)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    a, b = (np.array([r[i] for r in got], dtype=np.int64) for i in (0, 1))
    assert hash_longs(a, b).tolist() == [r.h for r in got]


def changes(df, **kw):
    return {tuple(r) for r in snapshot_changes(df, **kw).collect()}


def test_kinds(spark):
    rows = [
        ("snap-1", "https://www.A.example:443/X/index.html?utm_source=q#f", "A &amp; B", 1), ("snap-2", "http://a.example/x/", "A & B", 2),
        ("snap-1", "https://a.example/y", "old", 1), ("snap-2", "https://a.example/y", "new", 2), ("snap-2", "https://a.example/y", "old", 1),
        ("snap-1", "https://a.example/gone", None, 1), ("snap-2", "https://a.example/fresh", "t", None),
        ("snap-1", "https://a.example/z", "t", 1), ("snap-2", "https://a.example/z", None, 1), (None, "https://a.example/q", "t", 1), ("snap-2", " ", "t", 1), ("snap-2", None, "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash"))
    want = {("cmp-1-2", "a.example", "/y", "changed"), ("cmp-1-2", "a.example", "/gone", "removed"), ("cmp-1-2", "a.example", "/fresh", "added")}
    assert changes(df) == want == changes(df.union(df))
    assert changes(df.limit(0)) == set() == changes(df.where("run_id = 'snap-1'"))


def test_small_tables_are_enlarged(spark):
    rng = random.Random(2)
    state = [{f"https://h/{i}": f"t{rng.randrange(3)}" for i in rng.sample(range(400), 300)} for _ in range(3)]
    rows = [(f"snap-{k}", u, t, 1) for k, s in enumerate(state) for u, t in s.items()]
    want = set()
    for k in range(2):
        a, b = state[k], state[k + 1]
        want |= {(f"cmp-{k}-{k + 1}", "h", u[9:], kind) for u in a.keys() | b.keys() if (kind := "added" if u not in a else "removed" if u not in b else "changed" if a[u] != b[u] else None)}
    assert changes(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=200, width=4) == want


def test_shown():
    assert shown("  a​b c&amp;d ") == "ab c&d"
    assert shown("Café") == "Café" and shown(" ​") is None and shown(None) is None
