"""Connected components by alternating large-star and small-star steps.

Each step points every neighbour at the smallest node it has seen; stars of unequal size are fine,
as no neighbourhood is ever gathered: a step is an aggregated minimum joined back to the edges.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    others = down.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is its smallest node.

    Any orderable type will do, structs too.  Edges with a null end are ignored, loops keep their node, no edges
    give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    sound = edges.select("a", "b").where("a is not null and b is not null")
    loops = sound.where("a = b").select("a").distinct()
    star = scratch.cut(_small_star(sound.where("a <> b")), "star")
    while True:
        new = scratch.cut(_small_star(_large_star(star)), "star")
        same = [df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first() for df in (star, new)]
        scratch.drop(star)
        star = new
        if same[0] == same[1]:
            break
    out = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = out.unionByName(roots)
    alone = loops.select(F.col("a").alias("node")).join(out, "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))
