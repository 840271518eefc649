"""Numbers over a whole order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.scratch import Scratch


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with ``name``: 0, 1, 2 … in the order of ``by``, whose values are distinct.

    The order is range-partitioned and written, so that counts and ranks see the same partitions; each partition is
    numbered on its own, after the counts of those before it.
    """
    scratch = Scratch(rows.sparkSession)
    ordered = scratch.cut(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ordered.withColumn("_rank", rank).join(before, "_part").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")
