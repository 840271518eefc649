"""Cosine similarity of all rows of a part: exact by blocks, approximate by random projections, and what is built on the pairs.

The exact join cuts a part into blocks by the hash of the id; every pair of blocks is one group of
a bounded size whose products are one matrix multiplication.  Work is quadratic by nature; for large
parts use the approximate join, whose recall can be measured against the exact one: an inverted file of coarse
centroids, in which only rows of a list and those whose nearest centroid is hardly nearer meet.
Vectors of different lengths have no cosine and never meet: the length is part of every key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.operators.components import connected_components
from webloom.scratch import Scratch

BLOCK, GRID_LOW, IN_TASK = 1024, 0.80, 2_000
LARGE, CUTS = 1 << 23, 8  # numbers in a block of ``recall_by_lists``, blocks of a part at least
SAMPLE, ROWS_PER_LIST, MOST_LISTS, GAP = 20_000, 512, 4096, 0.2  # of the inverted file


def unit_rows(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """part, id, vec of length one; unusable vectors are left out."""
    v = F.col(vector).cast("array<double>")
    vec = F.transform(F.array(_length(v)), lambda n: F.transform(v, lambda x: x / n))[0]  # the length is taken once a row
    return rows.where(usable(v)).select(F.col("part"), F.col("id"), vec.alias("vec"))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no nulls, NaN or infinity, not all zero."""
    v = v.cast("array<double>")
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (_length(v) > 0) & (_length(v) < float("inf")), F.lit(False))


def _blocks(units: DataFrame, block: int | Column, cuts: int = 1) -> DataFrame:
    """Each row once for every other block of its part and length: part, dim, lo, hi, mine (its own block), id, vec.

    Up to ``cuts`` blocks are made of smaller parts, down to BLOCK rows, so that there is work for all tasks; parts must be
    few then: a join that shuffles by part would leave all blocks of a part in one task.
    """
    units = units.withColumn("dim", F.size("vec"))
    n = F.count("*")
    sizes = units.groupBy("part", "dim").agg(F.greatest(F.ceil(n / block), F.least(F.lit(cuts), F.ceil(n / BLOCK))).cast("int").alias("blocks"))
    placed = units.join(F.broadcast(sizes) if cuts > 1 else sizes, ["part", "dim"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).select("part", "dim", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "vec")


def _products(key: tuple, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi = key[-2:]
    a, b = pdf[pdf.mine == lo], pdf[pdf.mine == hi]
    if not len(a) or not len(b):
        return np.zeros((0, 0)), a.id.to_numpy(), b.id.to_numpy()
    return np.stack(a.vec.to_list()) @ np.stack(b.vec.to_list()).T, a.id.to_numpy(), b.id.to_numpy()


def cosine_pairs(rows: DataFrame, least: float, block: int = BLOCK, vector: str = "vector") -> DataFrame:
    """(part, a, b, sim) of all pairs a < b within a part with cosine of at least ``least``.

    rows: part, id, vector.  Null, zero and non-finite vectors have no pairs; ids are unique within a part.
    """

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sims, a, b = _products(key, pdf)
        if not sims.size:
            return pd.DataFrame({"part": [], "a": [], "b": [], "sim": []}).astype({"part": str})
        i, j = np.nonzero(sims >= least)
        one, two = a[i], b[j]
        keep = one < two if key[-2] == key[-1] else one != two
        one, two, s = one[keep], two[keep], sims[i, j][keep]
        return pd.DataFrame({"part": key[0], "a": np.minimum(one, two), "b": np.maximum(one, two), "sim": s})

    return _blocks(unit_rows(rows, vector), block).groupBy("part", "dim", "lo", "hi").applyInPandas(pairs, "part string, a long, b long, sim double")


def nearest_sims(rows: DataFrame, block: int = BLOCK, vector: str = "vector") -> DataFrame:
    """(part, id, nn): cosine of the nearest other row; alone in its part a row has none."""

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sims, a, b = _products(key, pdf)
        if not sims.size:
            return pd.DataFrame({"part": [], "id": [], "nn": []}).astype({"part": str})
        if key[-2] == key[-1]:
            np.fill_diagonal(sims, -np.inf)
        out = [pd.DataFrame({"part": key[0], "id": a, "nn": sims.max(1)}), pd.DataFrame({"part": key[0], "id": b, "nn": sims.max(0)})]
        out = pd.concat(out)
        return out[np.isfinite(out.nn)]

    found = _blocks(unit_rows(rows, vector), block).groupBy("part", "dim", "lo", "hi").applyInPandas(best, "part string, id long, nn double")
    return found.groupBy("part", "id").agg(F.max("nn").alias("nn"))


def coarse_centres(sample: np.ndarray, lists: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Spherical k-means: unit centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = (sample @ centres.T).argmax(1)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        sums = np.add.reduceat(sample[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[at[order][first]] = sums / np.where(size > 0, size, 1)
    return centres


def _index(units: DataFrame, sample: int, most_lists: int) -> dict[int, np.ndarray]:
    """Centres of each length, the same however the rows are laid out; units: part, id, vec, dim."""
    counts = {r.dim: r.n for r in units.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length
    index = {}
    for dim, n in counts.items():
        share = F.pmod(F.xxhash64("part", "id"), F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / n) * (1 << 30))
        some = units.where((F.col("dim") == dim) & (share | F.lit(n <= sample))).orderBy(F.xxhash64("part", "id"), "part", "id").select("vec").limit(sample)
        index[dim] = coarse_centres(np.stack([r.vec for r in some.collect()]), max(1, min(most_lists, n // ROWS_PER_LIST)))
    return index


def listed(rows: DataFrame, gap: float = GAP, sample: int = SAMPLE, most_lists: int = MOST_LISTS, vector: str = "vector") -> DataFrame:
    """(part, dim, list, home, id, vec): each row in the list of its nearest centre (home) and in all whose centre is within ``gap``.

    Centres are fitted per length on ``sample`` rows picked by hash; there is one for every ROWS_PER_LIST rows, ``most_lists`` at most.
    """
    units = unit_rows(rows, vector).withColumn("dim", F.size("vec"))
    index = _index(units, sample, most_lists)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # most_lists centres a length

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                near = np.stack(part.vec.to_list()) @ shared.value[dim].T
                row, at = np.nonzero(near >= near.max(1, keepdims=True) - gap)
                out = part.iloc[row].reset_index(drop=True)
                out["list"], out["home"] = at.astype(np.int32), near.argmax(1)[row] == at
                yield out[["part", "dim", "list", "home", "id", "vec"]]

    return units.select("part", "dim", "id", "vec").mapInPandas(place, "part string, dim int, list int, home boolean, id long, vec array<double>")


def ann_pairs(rows: DataFrame, least: float, gap: float = GAP, block: int = 4096, sample: int = SAMPLE, vector: str = "vector") -> DataFrame:
    """(part, a, b, sim) like ``cosine_pairs``, by an inverted file and exact cosines within lists; some are missed.

    A larger ``gap`` asks more lists and misses less; with 2 nothing is missed.  A list longer than ``block`` is cut into blocks of
    members and of askers, so that a dense list spreads over many tasks.
    """

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, q = pdf[pdf.member], pdf[pdf.asks]
        if not len(m) or not len(q):
            return pd.DataFrame({"part": [], "a": [], "b": [], "sim": []}).astype({"part": str})
        members, ids, out = np.stack(m.vec.to_list()), m.id.to_numpy(), []
        for at in range(0, len(q), 1024):
            some = q.iloc[at : at + 1024]
            sims = np.stack(some.vec.to_list()) @ members.T
            i, j = np.nonzero(sims >= least)
            out.append((some.id.to_numpy()[i], ids[j], sims[i, j]))
        a, b, s = (np.concatenate(x) for x in zip(*out))
        keep = a != b
        return pd.DataFrame({"part": key[0], "a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": s[keep]})

    placed = Scratch(rows.sparkSession).cut(listed(rows, gap, sample, vector=vector), "listed")
    sizes = placed.groupBy("part", "dim", "list").agg(F.count_if("home").alias("members"), F.count("*").alias("asking")).where("members > 0")
    sizes = sizes.select("part", "dim", "list", F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("asking") / block).cast("int").alias("qb"))
    met = placed.join(sizes, ["part", "dim", "list"])
    mine = {c: F.pmod(F.xxhash64("id", F.lit(c)), F.col(f"{c}b")).cast("int") for c in "mq"}
    # a member goes to every block of askers, an asker to every block of members
    cells = F.flatten(F.array(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda k: F.struct(mine["m"].alias("m"), k.alias("q"), F.lit(True).alias("member"), (k == mine["q"]).alias("asks")))).otherwise(F.array()),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("mb") - 1), lambda k: ~F.col("home") | (k != mine["m"])), lambda k: F.struct(k.alias("m"), mine["q"].alias("q"), F.lit(False).alias("member"), F.lit(True).alias("asks"))),
    ))
    each = met.select("part", "dim", "list", "id", "vec", F.explode(cells).alias("c")).select("part", "dim", "list", "c.*", "id", "vec")
    found = each.groupBy("part", "dim", "list", "m", "q").applyInPandas(pairs, "part string, a long, b long, sim double")
    return found.groupBy("part", "a", "b").agg(F.max("sim").alias("sim"))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list())


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _asked(vectors: np.ndarray, centres: np.ndarray, gap: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of so many rows at once the unit rows, the nearest list and which lists they are in."""
    for at in range(0, len(vectors), 1024):
        units = _unit(vectors[at : at + 1024])
        near = units @ centres.T
        yield units, near.argmax(1), near >= near.max(1, keepdims=True) - gap


def _looked(kept: DataFrame, shared: Broadcast, gap: float) -> DataFrame:
    """One row: looked, every.  Rows are counted where they lie; their vectors don't move."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (part, dim), rows in pdf.groupby(["part", "dim"], sort=False):
                lists = np.arange(len(shared.value[dim]), dtype=np.int32)
                m, q = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
                for _, home, asks in _asked(_stacked(rows.vec), shared.value[dim], gap):
                    m += np.bincount(home, minlength=len(lists))
                    q += asks.sum(0)
                yield pd.DataFrame({"part": part, "dim": dim, "list": lists, "m": m, "q": q})[q > 0]

    counted = kept.select("part", "dim", "vec").mapInPandas(count, "part string, dim int, list int, m long, q long")
    per = counted.groupBy("part", "dim", "list").agg(F.sum("m").alias("m"), F.sum("q").alias("q"))
    every = kept.groupBy("part", "dim").agg(F.count("*").alias("n"))
    looked = per.agg(F.sum(F.col("m") * F.col("q")).alias("looked"))
    return looked.crossJoin(every.agg(F.sum(F.col("n") * F.col("n")).alias("every")))  # one row each


def _usable_rows(rows: DataFrame, vector: str) -> DataFrame:
    """part, id, dim, vec as it is: narrow numbers stay narrow on their way."""
    return rows.where(usable(F.col(vector)) & F.col("part").isNotNull()).select("part", "id", F.size(vector).alias("dim"), F.col(vector).alias("vec"))


def candidates(rows: DataFrame, gap: float = GAP, vector: str = "vector") -> DataFrame:
    """One row: pairs of a row and a list's member that ``ann_pairs`` looks at, and all pairs of a part."""
    kept = Scratch(rows.sparkSession).cut(_usable_rows(rows, vector), "usable")
    shared = rows.sparkSession.sparkContext.broadcast(_index(unit_rows(kept, "vec").withColumn("dim", F.size("vec")), SAMPLE, MOST_LISTS))
    return _looked(kept, shared, gap)


def recall_by_lists(rows: DataFrame, least: float, gap: float = GAP, sample: int = SAMPLE, most_lists: int = MOST_LISTS, block: int = LARGE, vector: str = "vector") -> DataFrame:
    """One row: exact pairs, how many of them ``ann_pairs`` finds, their share (recall, 1 if there are none), looked and every as in ``candidates``.

    ``ann_pairs`` finds a pair where one row is in the home list of the other, so each pair of blocks tells its own
    pairs and hits and no pair is written.  All pairs are compared, in single precision; those too near to ``least``
    for it are compared again in double.  ``block`` is in numbers: rows are sent once for every other block, as narrow as they came.
    """
    kept = Scratch(rows.sparkSession).cut(_usable_rows(rows, vector), "usable")
    shared = rows.sparkSession.sparkContext.broadcast(_index(unit_rows(kept, "vec").withColumn("dim", F.size("vec")), sample, most_lists))

    def block_of(pdf: pd.DataFrame, centres: np.ndarray) -> tuple:
        vectors = _stacked(pdf.vec)
        some = [(u.astype(np.float32), h, np.packbits(asks, axis=1, bitorder="little")) for u, h, asks in _asked(vectors, centres, gap)]
        return pdf.id.to_numpy(), vectors, *(np.concatenate(x) for x in zip(*some))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, dim, lo, hi = key
        a, b = pdf[pdf.mine == lo], pdf[pdf.mine == hi]
        if not len(a) or not len(b):
            return pd.DataFrame({"pairs": [], "found": []}).astype("int64")
        ids_a, a, a32, home_a, asks_a = one = block_of(a, shared.value[dim])
        ids_b, b, b32, home_b, asks_b = one if lo == hi else block_of(b, shared.value[dim])
        slack = (dim + 4) * 2.0**-23  # above any error of single precision
        pairs = found = 0
        for x in range(0, len(a), 256):
            for y in range(x if lo == hi else 0, len(b), 1024):
                sims = a32[x : x + 256] @ b32[y : y + 1024].T
                at = np.flatnonzero(sims >= np.float32(least - slack))
                if not len(at):
                    continue
                i, j = np.divmod(at, sims.shape[1])
                sure, i, j = sims.ravel()[at] >= np.float32(least + slack), i + x, j + y
                unsure = np.flatnonzero(~sure)
                for k in np.split(unsure, range(4096, len(unsure), 4096)):
                    sure[k] = np.einsum("ij,ij->i", _unit(a[i[k]]), _unit(b[j[k]])) >= least
                keep = sure & (ids_a[i] != ids_b[j]) & ((i < j) | (lo != hi))
                i, j = i[keep], j[keep]
                hit = asks_a[i, home_b[j] >> 3] >> (home_b[j] & 7) | asks_b[j, home_a[i] >> 3] >> (home_a[i] & 7)
                pairs, found = pairs + len(i), found + int((hit & 1).sum())
        return pd.DataFrame({"pairs": [pairs], "found": [found]})

    met = _blocks(kept.select("part", "id", "vec"), F.lit(block) / F.col("dim"), CUTS).groupBy("part", "dim", "lo", "hi").applyInPandas(compare, "pairs long, found long")
    sums = met.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    share = F.coalesce(F.col("found") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(1.0))
    return sums.withColumn("recall", share).crossJoin(_looked(kept, shared, gap))  # one row each


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: share of exact pairs that the approximate join found, 1 if there are none."""
    hit = exact.select("part", "a", "b").join(approximate.select("part", "a", "b", F.lit(1).alias("hit")), ["part", "a", "b"], "left")
    return hit.agg(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("recall"))


def distribution(nn: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per part: pages, percentiles of the nearest similarity and numbers of pairs from 0.80 to 0.95."""
    marks = [0.5, 0.9, 0.95, 0.99, 0.999]
    pct = nn.groupBy("part").agg(F.percentile("nn", F.array(*(F.lit(m) for m in marks))).alias("p"))
    grid = [round(GRID_LOW + k / 100, 2) for k in range(16)]
    counts = pairs.groupBy("part").agg(*(F.count_if(F.col("sim") >= t).alias(f"pairs_at_{t:.2f}") for t in grid))
    out = sizes.join(pct, "part", "left").join(counts, "part", "left")
    names = ["p50", "p90", "p95", "p99", "p99_9"]
    return out.select("part", "pages", *(F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(names)), *(F.coalesce(F.col(f"`pairs_at_{t:.2f}`"), F.lit(0)).alias(f"pairs_at_{t:.2f}") for t in grid))


def percentile_ranks(values: DataFrame, value: str, nn: DataFrame) -> DataFrame:
    """values with ``percentile``: share of nn at most the value, in percent; values are on a grid of 0.0001.

    The sample is counted in the cells of that grid, so the running sum is over some ten thousand rows at most.
    """
    cell = lambda c: F.ceil(F.round(F.col(c) * 10_000, 6)).cast("int")
    cells = nn.groupBy(cell("nn").alias("cell")).agg(F.count("*").alias("n"))
    wanted = values.select(cell(value).alias("cell")).distinct().withColumn("n", F.lit(0).cast("long"))
    steps = cells.unionByName(wanted).groupBy("cell").agg(F.sum("n").alias("n"))
    upto = steps.select("cell", F.sum("n").over(Window.orderBy("cell")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    share = F.coalesce(F.round(F.try_divide(F.col("upto") * 100, F.col("all")), 2), F.lit(0.0)).alias("percentile")
    return values.withColumn("cell", cell(value)).join(upto.select("cell", share), "cell").drop("cell")


def single_linkage(pairs: DataFrame) -> DataFrame:
    """(part, id, cluster): connected pages; cluster is the smallest id."""
    edges = pairs.select(F.struct("part", F.col("a").alias("id")).alias("a"), F.struct("part", F.col("b").alias("id")).alias("b"))
    return connected_components(edges).select("node.part", "node.id", F.col("component.id").alias("cluster"))


def complete_linkage(pairs: DataFrame, rows: DataFrame, least: float, vector: str = "vector", most: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(part, id, cluster): clusters all of whose pairs are at least ``least`` similar, grown from the closest pair.

    Components of the pairs never interact, so each of up to ``in_task`` rows is one group; inside, pairs are taken by
    falling similarity, then id, and clusters merge if every cross pair is similar enough.  Larger components grow by
    joins to the same clusters.  Cluster is the smallest id; rows in no cluster have no row.  With ``most``, larger
    components are refused.
    """
    scratch = Scratch(pairs.sparkSession)
    pairs = scratch.cut(pairs, "pairs")
    comp = scratch.cut(single_linkage(pairs), "components")
    sizes = comp.groupBy("part", "cluster").agg(F.count("*").alias("n"))
    if most is not None and sizes.where(F.col("n") > most).limit(1).count():
        raise ValueError(f"a connected component has more than {most} rows")
    sized = scratch.cut(comp.join(sizes, ["part", "cluster"]), "sized")
    large, comp = (sized.where(test).select("part", "id", "cluster") for test in (F.col("n") > in_task, F.col("n") <= in_task))
    edges = scratch.cut(pairs.join(comp.withColumnRenamed("id", "a"), ["part", "a"]).select("part", "cluster", "a", "b", "sim"), "edges")
    units = scratch.cut(unit_rows(rows, vector).join(comp, ["part", "id"]).select("part", "cluster", "id", "vec"), "units")

    def grow(key: tuple, e: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        at = {i: k for k, i in enumerate(u.id)}
        v = np.stack(u.vec.to_list())
        of: dict[int, int] = {}
        members: list[list[int]] = []
        for a, b in e.sort_values(["sim", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
            ca, cb = of.get(a), of.get(b)
            if ca is not None and ca == cb:
                continue
            left, right = (members[ca] if ca is not None else [a]), (members[cb] if cb is not None else [b])
            if (ca is not None or cb is not None) and (v[[at[i] for i in left]] @ v[[at[i] for i in right]].T < least).any():
                continue
            target = ca if ca is not None else cb
            if target is None:
                target = len(members)
                members.append([])
            merged = sorted({*left, *right})
            if ca is not None and cb is not None:
                members[cb] = []
            members[target] = merged
            for i in merged:
                of[i] = target
        rows = [(key[0], i, m[0]) for m in members if len(m) > 1 for i in m]
        return pd.DataFrame(rows, columns=["part", "id", "cluster"])

    out = edges.groupBy("part", "cluster").cogroup(units.groupBy("part", "cluster")).applyInPandas(grow, "part string, id long, cluster long")
    return out.unionByName(_grown_by_joins(scratch, pairs, rows, large, least, vector)) if large.limit(1).count() else out


def _grown_by_joins(scratch: Scratch, pairs: DataFrame, rows: DataFrame, ids: DataFrame, least: float, vector: str) -> DataFrame:
    """Complete linkage of the rows of ``ids`` in rounds that each merge all clusters whose first link is each other's.

    A link between two clusters can't rise when others merge, so these merges are those of the sequential order.  Two
    clusters with a cross pair that isn't similar never merge and are dropped.  Rounds are few unless many
    similarities are equal or fall along a chain: each round merges at least one pair.
    """
    key = ["part", "a", "b"]
    ids = ids.select("part", "id")
    near = cosine_pairs(rows.join(ids, ["part", "id"], "left_semi"), least, vector=vector).select(*key)
    links = pairs.join(ids.withColumnRenamed("id", "a"), ["part", "a"], "left_semi").select(*key, F.struct("sim", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("first"))
    live = scratch.cut(near.join(links, key, "full_outer").select(*key, F.lit(1).cast("long").alias("n"), "first"), "live")
    members = scratch.cut(ids.withColumn("cluster", F.col("id")), "members")
    while True:
        ends = live.where("first is not null").select("part", "first", F.explode(F.array("a", "b")).alias("c")).groupBy("part", "c").agg(F.max("first").alias("first"))
        mutual = ends.groupBy("part", "first").agg(F.count("*").alias("n"), F.min("c").alias("keep"), F.max("c").alias("gone")).where("n = 2")
        merges = scratch.cut(mutual.select("part", "gone", "keep"), "merges")
        if not merges.limit(1).count():
            break

        def renamed(df: DataFrame, c: str) -> DataFrame:
            return df.join(merges.select("part", F.col("gone").alias(c), "keep"), ["part", c], "left").withColumn(c, F.coalesce("keep", c)).drop("keep")  # noqa: B023

        grown = scratch.cut(renamed(members, "cluster").select("part", "id", "cluster"), "members")
        sizes = grown.groupBy("part", "cluster").agg(F.count("*").alias("size"))
        size = {c: sizes.select("part", F.col("cluster").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab"}
        met = renamed(renamed(live, "a"), "b").where("a <> b").select("part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "first")
        met = met.groupBy(*key).agg(F.sum("n").alias("n"), F.max("first").alias("first")).join(size["a"], ["part", "a"]).join(size["b"], ["part", "b"])
        kept = scratch.cut(met.where("n = size_a * size_b").select(*key, "n", "first"), "live")
        scratch.drop(live, members, merges)
        live, members = kept, grown
    found = members.groupBy("part", "cluster").agg(F.count("*").alias("n")).where("n > 1").select("part", "cluster")
    return members.join(found, ["part", "cluster"], "left_semi").select("part", "id", "cluster")


def cluster_cohesion(clusters: DataFrame, rows: DataFrame, block: int = BLOCK, vector: str = "vector") -> DataFrame:
    """(part, cluster, size, min_sim, mean_sim, cohesion) over all pairs of members, by blocks."""
    members = clusters.join(rows.select("part", "id", vector), ["part", "id"])
    inside = members.select(F.concat_ws("\x1f", "part", "cluster").alias("part"), "id", F.col(vector).alias("vector"))

    def stats(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sims, a, b = _products(key, pdf)
        use = sims[np.triu_indices(len(a), 1)] if key[-2] == key[-1] else sims.ravel()
        return pd.DataFrame([(key[0], float(use.min()), float(use.sum()), len(use))] if use.size else [], columns=["part", "low", "total", "n"])

    found = _blocks(unit_rows(inside), block).groupBy("part", "dim", "lo", "hi").applyInPandas(stats, "part string, low double, total double, n long")
    sums = found.groupBy("part").agg(F.min("low").alias("min_sim"), (F.sum("total") / F.sum("n")).alias("mean_sim"))
    sizes = clusters.groupBy("part", "cluster").agg(F.count("*").alias("size"))
    cohesion = F.when(F.col("mean_sim") > 0, F.col("min_sim") / F.col("mean_sim")).otherwise(0.0)
    named = sums.select(F.split_part("part", F.lit("\x1f"), F.lit(1)).alias("p"), F.split_part("part", F.lit("\x1f"), F.lit(2)).cast("long").alias("cluster"), "min_sim", "mean_sim", cohesion.alias("cohesion"))
    return sizes.join(named.withColumnRenamed("p", "part"), ["part", "cluster"])


def centroid_sims(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """(part, id, sim) to the mean of the part's unit vectors; the mean is summed by dimension, not gathered."""
    units = unit_rows(rows, vector)
    mean = units.select("part", F.posexplode("vec").alias("d", "x")).groupBy("part", "d").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))  # one entry a dimension
    dot = F.aggregate(F.zip_with("vec", F.col("c.x"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(F.col("c.x"), F.lit(0.0), lambda s, x: s + x * x))
    return units.join(centre, "part").select("part", "id", F.when(length > 0, dot / length).otherwise(0.0).alias("sim"))


def projection(rows: DataFrame, dims: int = 2, vector: str = "vector") -> DataFrame:
    """(part, id, x, y) on the first principal axes, the sign such that the largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    units = unit_rows(rows, vector)
    means = units.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).orderBy("d").collect()  # one row a dimension
    centred = units.withColumn("f", array_to_vector(F.zip_with("vec", F.array(*(F.lit(r.x) for r in means)), lambda x, y: x - y)))
    model = PCA(k=dims, inputCol="f", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(dims)])
    p = vector_to_array("p")
    xy = [F.round(F.get(p, F.lit(i)) * float(signs[i]), 6).alias(n) for i, n in enumerate(("x", "y")[:dims])]
    return model.transform(centred).select("part", "id", *xy)
