"""Tables that cut lineage, kept in the shared folder of the session.

``spark.checkpoint.dir`` names the folder.  Where it is unset (tests, local runs) a
temporary folder is made; on a cluster without the setting that is an error, as the
executors could not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    if not getattr(spark, "_webloom_dir", None):
        spark._webloom_dir = tempfile.mkdtemp(prefix="webloom-")
    return spark._webloom_dir


class Scratch:
    """Written tables of one operator run; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self._paths = spark, f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{label}-{len(self._paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[path] = out
        return out

    def together(self, *frames: DataFrame) -> DataFrame:
        """The rows of frames of one schema made by ``cut``, as one scan of their files rather than a union of scans."""
        paths = [p for p, df in self._paths.items() if any(df is x for x in frames)]
        return self.spark.read.schema(frames[0].schema).parquet(*paths)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files behind frames made by ``cut``; others are ignored."""
        for path in [p for p, df in self._paths.items() if any(df is x for x in frames)]:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            self._paths[path] = None
