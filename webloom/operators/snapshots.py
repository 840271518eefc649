"""What changed between consecutive full snapshots, from invertible Bloom lookup tables.

Each snapshot row becomes an element (key hash, value hash).  Elements of a hash bucket are
folded into a table of cells (signed count, xor of keys, of values and of checks) while still on
the map side; the tables of two snapshots are subtracted in the same aggregation, so what is
equal on both sides cancels and only cells of differing elements go on.  Each bucket is then
peeled on its own; a bucket whose table was too small is done again with cells doubled.  The
shuffle carries cells, whose number follows the differences, not the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.functions.titles import shown_text
from webloom.functions.urls import plain_host, plain_path
from webloom.scratch import Scratch

ROWS_PER_BUCKET, WIDTH, HASHES, ROUNDS = 1024, 64, 3, 12
_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def hash_longs(*values: np.ndarray) -> np.ndarray:
    """XXH64 of longs, each seeded by the one before, 42 first: what Spark's xxhash64 gives for long columns."""
    h = np.full(len(values[0]), 42, dtype=_U)
    with np.errstate(over="ignore"):
        for v in values:
            h = h + _P5 + _U(8)
            h = _rot(h ^ (_rot(v.astype(_U) * _P2, 31) * _P1), 27) * _P1 + _P4
            h = (h ^ (h >> _U(33))) * _P2
            h = (h ^ (h >> _U(29))) * _P3
            h = h ^ (h >> _U(32))
    return h.astype(np.int64)


def _slot(j: int, width: int, key, value):
    return j * width + F.pmod(F.xxhash64(key, value, F.lit(j).cast("long")), F.lit(width).cast("long"))


def _cells(rows: DataFrame, width: int) -> DataFrame:
    """Cells of all (session, bucket) that don't cancel. rows: session, bucket, sign, k, v."""
    check = F.xxhash64("k", "v", F.lit(HASHES).cast("long"))
    each = rows.withColumn("check", check).withColumn("slot", F.explode(F.array(*(_slot(j, width, F.col("k"), F.col("v")) for j in range(HASHES)))))
    sums = each.groupBy("session", "bucket", "slot").agg(F.sum("sign").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("v").alias("v"), F.bit_xor("check").alias("c"))
    return sums.where("n <> 0 or k <> 0 or v <> 0 or c <> 0")


_FOUND = T.StructType([T.StructField("session", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("sign", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])


def peel(slot: np.ndarray, n: np.ndarray, k: np.ndarray, v: np.ndarray, c: np.ndarray, width: int) -> list[tuple[int, int, int]] | None:
    """(sign, key, value) of all elements in a table of cells, or None if it can't be peeled whole."""
    size = HASHES * width
    tn, tk, tv, tc = (np.zeros(size, dtype=np.int64) for _ in range(4))
    tn[slot], tk[slot], tv[slot], tc[slot] = n, k, v, c
    digest, out = np.bitwise_xor.reduce(tc[:width]), []
    while True:
        at = np.flatnonzero(np.abs(tn) == 1)
        at = at[hash_longs(tk[at], tv[at], np.full(len(at), HASHES)) == tc[at]]
        if not len(at):
            break
        sign, kk, vv, cc = tn[at], tk[at], tv[at], tc[at]
        _, first = np.unique(np.stack([kk, vv]), axis=1, return_index=True)  # an element may be alone in several cells
        sign, kk, vv, cc = sign[first], kk[first], vv[first], cc[first]
        out += zip(sign.tolist(), kk.tolist(), vv.tolist())
        for j in range(HASHES):
            where = j * width + np.mod(hash_longs(kk, vv, np.full(len(kk), j)), width)
            np.subtract.at(tn, where, sign)
            for table, x in ((tk, kk), (tv, vv), (tc, cc)):
                np.bitwise_xor.at(table, where, x)
        if len(out) > size:
            return None
    whole = not (tn.any() or tk.any() or tv.any() or tc.any())
    keys, values = np.array([x[1] for x in out], dtype=np.int64), np.array([x[2] for x in out], dtype=np.int64)
    if not whole or np.bitwise_xor.reduce(hash_longs(keys, values, np.full(len(keys), HASHES))) != digest:
        return None
    return out


def _peeler(width: int):
    def peel_bucket(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        found = peel(*(cells[x].to_numpy() for x in ("slot", "n", "k", "v", "c")), width)
        rows = [(*key, 0, 0, 0)] if found is None else [(*key, *x) for x in found]  # sign 0: too small
        return pd.DataFrame(rows, columns=["session", "bucket", "sign", "k", "v"])

    return peel_bucket


def differing_elements(scratch: Scratch, rows: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(session, sign, k, v) of the elements that only one side of a session holds; sign -1: the earlier side.

    rows: session, bucket, sign, k, v.  Buckets that fail in the last round are subtracted exactly.
    """
    parts, todo = [], rows
    for _ in range(rounds):
        found = scratch.cut(_cells(todo, width).groupBy("session", "bucket").applyInPandas(_peeler(width), _FOUND), "found")
        parts.append(found.where("sign <> 0"))
        failed = found.where("sign = 0").select("session", "bucket")
        if not failed.limit(1).count():
            break
        todo, width = rows.join(failed, ["session", "bucket"], "left_semi"), width * 2
    else:
        exact = todo.groupBy("session", "bucket", "k", "v").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        parts.append(exact)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("session", "sign", "k", "v")


def snapshot_changes(pages: DataFrame, run: str = "run_id", url: str = "url", title: str = "title", at: str = "fetched_at", prefix: str = "snap-", session: str = "cmp-", rows_per_bucket: int = ROWS_PER_BUCKET, width: int = WIDTH) -> DataFrame:
    """(session_id, host, path, change_kind): ``added``, ``removed`` or ``changed`` between consecutive runs.

    A page is present if any row names its address; its row of the latest ``at`` counts (null is oldest, ties go
    to the greatest title).  ``changed``: both titles are present and show a reader different text.  Rows without
    run or address are left out; a single run gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.where(F.col(run).isNotNull() & (F.trim(url) != "")).select(F.col(run).alias("run"), plain_host(F.col(url)).alias("host"), plain_path(F.col(url)).alias("path"), F.struct(F.col(at).alias("at"), F.col(title).alias("title")).alias("row"))
    state = rows.groupBy("run", "host", "path").agg(F.max("row").alias("row")).select("run", "host", "path", shown_text("row.title").alias("title"))
    state = scratch.cut(state.select("*", F.xxhash64("host", "path").alias("k"), F.coalesce(F.xxhash64(F.col("title")), F.lit(0)).alias("v")), "state")
    runs = state.groupBy("run").agg(F.count("*").alias("n"))  # one row a snapshot
    order = Window.orderBy("run")
    cut = lambda c: F.regexp_replace(c, f"^{prefix}", "")
    pairs = runs.select("run", "n", F.lead("run").over(order).alias("later"), F.lead("n").over(order).alias("m")).where("later is not null")
    pairs = pairs.withColumn("session", F.concat(F.lit(session), cut(F.col("run")), F.lit("-"), cut(F.col("later")))).withColumn("buckets", F.ceil(F.greatest("n", "m") / rows_per_bucket))
    pairs = scratch.cut(pairs, "pairs")
    sides = pairs.select(F.col("run").alias("run"), "session", "buckets", F.lit(-1).alias("sign")).unionByName(pairs.select(F.col("later").alias("run"), "session", "buckets", F.lit(1).alias("sign")))
    elements = state.select("run", "k", "v").join(sides, "run").select("session", F.pmod("k", "buckets").alias("bucket"), "sign", "k", "v")
    found = differing_elements(scratch, elements, width).join(sides.select("session", "sign", "run"), ["session", "sign"])
    met = found.join(state, ["run", "k", "v"]).groupBy("session", "host", "path").agg(
        F.min("sign").alias("lo"), F.max("sign").alias("hi"), F.count("title").alias("titles"))
    kind = F.when(F.col("hi") < 0, "removed").when(F.col("lo") > 0, "added").when(F.col("titles") == 2, "changed")
    return met.select(F.col("session").alias("session_id"), "host", "path", kind.alias("change_kind")).where("change_kind is not null")
