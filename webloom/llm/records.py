"""Shared readings of the crawl tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.tables import table


def newest(rows: DataFrame, *columns: str, **made: Column) -> DataFrame:
    """The row of the latest fetched_at of each (run_id, url_id): ``columns`` and the expressions ``made``.

    A null fetched_at is oldest; ties go to the later loaded_at, then to the greater values.  Rows without a key
    are left out.  Expressions are computed before the shuffle, so that only their results travel.
    """
    names = [*columns, *made]
    rows = rows.where("run_id is not null and url_id is not null")
    rows = rows.select("run_id", "url_id", "fetched_at", "loaded_at", *columns, *(c.alias(n) for n, c in made.items()))
    best = F.max(F.struct("fetched_at", "loaded_at", *names)).alias("best")
    return rows.groupBy("run_id", "url_id").agg(best).select("run_id", "url_id", *(f"best.{c}" for c in names))


def records(spark: SparkSession, folder: str, *columns: str, **made: Column) -> DataFrame:
    return newest(table(spark, folder, "analysis_rows"), *columns, **made)


def sampled(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``keys``, copies once: the same at every run.

    Only hashes go to the driver to find the limit; the rows are then filtered where they are.
    """
    h = F.xxhash64(*keys)
    last = rows.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h").alias("h")).first().h
    return rows.where(h <= last).dropDuplicates(list(keys)) if last is not None else rows.limit(0)
