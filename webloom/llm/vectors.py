"""Most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every row is indexed and every row
asks.  A row's list is that of its nearest centroid; it asks all lists whose centroid is within
``gap`` of the nearest, so the number of lists asked follows the geometry and isn't fixed.
In a list the asymmetric tables (query against codebook, per sub-space) rule out what is more
than ``sigmas`` quantisation errors below the floor; what is left is ranked by exact cosine.
Exact copies are one entry of the index and come back as such.  A list longer than ``block`` is
cut into blocks of members and of queries, so a dense list spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.scratch import Scratch

SAMPLE, ROWS_PER_LIST, MOST_LISTS, SUBSPACES, CODES = 20_000, 512, 2048, 8, 256
PAIRS = 200_000  # vectors of so many pairs are held at once


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, spherical: bool) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ centres.T
        if not spherical:
            score -= 0.5 * (centres**2).sum(1)
        at = score.argmax(1)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        sums, used = np.add.reduceat(x[order], starts, axis=0), at[order][starts]
        if spherical:
            size = np.linalg.norm(sums, axis=1, keepdims=True)
        else:
            size = np.diff(np.r_[starts, len(x)])[:, None]
        centres[used] = sums / np.where(size == 0, 1, size)
    return centres.astype(np.float32)


@dataclass
class Index:
    """Coarse centroids (lists, dim) and codebooks (subspace, code, dim / subspaces, padded)."""

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 7, most_lists: int = MOST_LISTS) -> Index:
        rng = np.random.default_rng(seed)
        centres = _kmeans(sample, int(np.clip(rows // ROWS_PER_LIST, 1, most_lists)), rng, 8, True)
        rest = cls._split(sample - centres[(sample @ centres.T).argmax(1)])
        return cls(centres, np.stack([np.resize(b := _kmeans(rest[:, m], CODES, rng, 6, False), (CODES, b.shape[1])) for m in range(SUBSPACES)]))

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SUBSPACES
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), SUBSPACES, -1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes miss."""
        rest = self._split(x - self.centres[home])
        codes = np.empty((len(x), SUBSPACES), dtype=np.uint8)
        missed = np.zeros(len(x), dtype=np.float32)
        for m, book in enumerate(self.books):
            codes[:, m] = (rest[:, m] @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            missed += ((rest[:, m] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def scores(self, queries: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosine of each query with each member of one list, by table look-up."""
        parts = self._split(queries)
        out = np.repeat((queries @ self.centres[list_id])[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            out += np.take(parts[:, m] @ book.T, codes[:, m], axis=1)
        return out


def unit_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, model, dim, key, vec): length one, as float32 bytes; null, all-zero and non-finite vectors are left out."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes, ids, models, out = np.diff(ends), b.column(0), b.column(1), []
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                x = flat[ends[at][:, None] + np.arange(dim)]
                top = np.abs(x).max(1)
                good = np.isfinite(top) & (top > 0)
                at, x = at[good], x[good] / top[good, None]
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                keys = [xxhash.xxh3_128_digest(k.tobytes()) for k in np.round(x * 1e5).astype(np.int32)]
                take = pa.array(at)
                out.append(pa.RecordBatch.from_arrays([ids.take(take), models.take(take), pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "model", "dim", "key", "vec"]))
            yield from out

    sound = rows.select("id", F.coalesce(F.col("model"), F.lit("")).alias("model"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null and not exists(vector, x -> x is null)")
    return sound.mapInArrow(scale, "id long, model string, dim int, key binary, vec binary")


def _stack(vecs) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=np.float32).reshape(len(vecs), -1)


def _assign(index: dict[tuple[str, int], Index], gap: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for key, part in pdf.groupby(["model", "dim"], sort=False):
                ix, x = index[key], _stack(part.vec.tolist())
                near = x @ ix.centres.T
                home = near.argmax(1)
                codes, missed = ix.encode(x, home)
                row, asked = np.nonzero(near >= near.max(1, keepdims=True) - gap)
                is_home = asked == home[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.model.to_numpy()[row]), pa.array(part.dim.to_numpy()[row].astype(np.int32)), pa.array(asked.astype(np.int32)), pa.array(is_home), pa.array(part.id.to_numpy()[row]), pa.array(part.vec.to_numpy()[row]),
                     pa.array([codes[r].tobytes() if h else None for r, h in zip(row, is_home)], pa.binary()), pa.array(missed[row], pa.float32())],
                    names=["model", "dim", "list", "home", "id", "vec", "codes", "missed"],
                )

    return assign


def _best(sim: np.ndarray, ok: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> list[np.ndarray]:
    """(left id, right id, sim) of the k best of each row among ok ones, ties to the smaller right id."""
    r, c = np.nonzero(ok)
    s = sim[r, c]
    order = np.lexsort((right[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return [left[r[keep]], right[c[keep]], s[keep]]


def _searcher(index: dict[tuple[str, int], Index], k: int, least: float, sigmas: float):
    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, dim, list_id = key[:3]
        ix, member, ask = index[model, dim], pdf.codes.notna() & pdf.member, pdf.asks
        m, q = pdf[member], pdf[ask]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        codes, mv, mid = np.frombuffer(b"".join(m.codes), dtype=np.uint8).reshape(len(m), -1), _stack(m.vec.tolist()), m.id.to_numpy()
        floor = least - sigmas * m.missed.to_numpy() / np.sqrt(dim)
        out: list[list[np.ndarray]] = []
        for at in range(0, len(q), 1024):
            part = q.iloc[at : at + 1024]
            qv, qid = _stack(part.vec.tolist()), part.id.to_numpy()
            r, c = np.nonzero(ix.scores(qv, list_id, codes) >= floor)
            sim = np.full((len(part), len(m)), -2.0)
            for lo in range(0, len(r), PAIRS):
                x, y = r[lo : lo + PAIRS], c[lo : lo + PAIRS]
                sim[x, y] = np.einsum("ij,ij->i", qv[x], mv[y], dtype=np.float64)
            ok = (sim >= least) & (qid[:, None] != mid[None, :])
            out += [_best(sim, ok, qid, mid, k), _best(sim.T, ok.T, mid, qid, k)]
        a, b, s = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "sim": s})

    return search


def nearest_neighbours(rows: DataFrame, k: int = 5, least: float = 0.85, gap: float = 0.1, sigmas: float = 4.0, block: int = 4096, sample: int = SAMPLE, most_lists: int = MOST_LISTS) -> DataFrame:
    """(id, neighbour, sim): the ``k`` rows of highest cosine, at least ``least``, of every row, within its model.

    There is a list for every ROWS_PER_LIST rows of a model, ``most_lists`` at most; raise it and ``sample`` with the rows, as
    lists grow beyond it.  ``gap=2, sigmas=inf`` asks all lists and rules nothing out: the exact way.
    rows: id, model, embedding; ids are unique.  Null model is a model of its own; unusable vectors and vectors
    of another length have no part in each other; ties go to the smaller id; an empty table gives no rows.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    units = scratch.cut(unit_vectors(rows), "units")
    group = units.groupBy("model", "dim", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = scratch.cut(group, "classes")
    counts = {(r.model, r.dim): r.n for r in classes.groupBy("model", "dim").agg(F.count("*").alias("n")).collect()}  # one row a model
    if not counts:
        return spark.createDataFrame([], "id long, neighbour long, sim double")
    pick = F.row_number().over(Window.partitionBy("model", "dim").orderBy(F.xxhash64("rep"), "rep"))
    chosen = classes.select("model", "dim", "rep", "vec").withColumn("pick", pick).where(F.col("pick") <= sample).select("model", "dim", "vec").toPandas()
    index = {key: Index.fit(_stack(part.vec.tolist()), counts[key], most_lists=most_lists) for key, part in chosen.groupby(["model", "dim"])}

    asked = classes.select("model", "dim", F.col("rep").alias("id"), "vec").mapInArrow(_assign(index, gap), "model string, dim int, list int, home boolean, id long, vec binary, codes binary, missed float")
    asked = scratch.cut(asked, "asked")
    sizes = asked.groupBy("model", "dim", "list").agg(F.count_if("home").alias("members"), F.count("*").alias("asking"))
    sizes = sizes.where("members > 0").select("model", "dim", "list", F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("asking") / (4 * block)).cast("int").alias("qb"))
    # at most one row a list: len(index) * MOST_LISTS
    placed = asked.join(F.broadcast(sizes), ["model", "dim", "list"])
    own_m, own_q = F.pmod(F.xxhash64("id"), F.col("mb")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("qb")).cast("int")
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda j: F.struct(i.alias("m"), j.alias("q"))))))
    placed = placed.withColumn("own_m", own_m).withColumn("own_q", own_q).withColumn("cell", cells)
    placed = placed.withColumn("member", F.col("home") & (F.col("cell.m") == F.col("own_m"))).withColumn("asks", F.col("cell.q") == F.col("own_q")).where("member or asks")
    found = (
        placed.select("model", "dim", "list", F.col("cell.m").alias("m"), F.col("cell.q").alias("q"), "id", "vec", "codes", "missed", "member", "asks")
        .groupBy("model", "dim", "list", "m", "q").applyInPandas(_searcher(index, k, least, sigmas), "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    )
    return _with_copies(scratch, units, classes, found, k, least)


def _with_copies(scratch: Scratch, units: DataFrame, classes: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of rows from neighbours of classes; no more than k + 1 copies of a class are ever carried."""
    best = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    found = scratch.cut(found.withColumn("rank", best("a", F.desc("sim"), "b")).where(F.col("rank") <= k).drop("rank"), "found")
    many = classes.where("copies > 1").select("model", "dim", "key", "rep")
    if not many.limit(1).count():
        return found.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "sim")
    members = scratch.cut(units.select("model", "dim", "key", "id").join(classes.select("model", "dim", "key", "rep", "copies"), ["model", "dim", "key"]).select("rep", "id", "copies"), "members")
    few = members.withColumn("rank", best("rep", "id")).where(F.col("rank") <= k + 1).select("rep", F.col("id").alias("copy"))
    near = found.select("a", F.col("b").alias("rep"), "sim").join(few, "rep").select("a", "copy", "sim")
    if least <= 1:
        near = near.unionByName(few.join(many.select("rep"), "rep").select(F.col("rep").alias("a"), "copy", F.lit(2.0).alias("sim")))
    near = near.withColumn("rank", best("a", F.desc("sim"), "copy")).where(F.col("rank") <= k + 1)
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "copy", "sim"))).alias("near"))
    each = members.join(lists, F.col("rep") == F.col("a"))
    kept = F.slice(F.filter("near", lambda x: x["copy"] != F.col("id")), 1, k)
    return each.select("id", F.explode(kept).alias("x")).select("id", F.col("x.copy").alias("neighbour"), F.least(F.col("x.sim"), F.lit(1.0)).alias("sim"))
