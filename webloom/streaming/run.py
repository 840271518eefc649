"""Running a stream over what there is and reading back its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.scratch import Scratch


def drained(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 8) -> DataFrame:
    """All rows a stream over ``source`` puts out when run until its input ends, with their batch number.

    The source is written to files first; offsets, state and output lie in the shared folder.
    """
    scratch = Scratch(spark)
    path = f"{scratch.base}/stream"
    source.repartition(files).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(StructType.fromJson(source.schema.jsonValue())).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    made = transform(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # a batch done twice replaces itself

    query = made.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*made.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out")
