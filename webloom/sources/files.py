"""Small files on whatever file system a path names, through the session's Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file with this text, in place of what was there; folders above are made."""
    system, where = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete, a folder with all in it."""
    system, where = _at(spark, path)
    return bool(system.exists(where)) and bool(system.delete(where, True))


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return bool(system.exists(where))
