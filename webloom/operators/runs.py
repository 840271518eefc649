"""Registry of crawl runs and the life of their data."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, status string, seeds array<string>, config_hash string, config string, created_at timestamp, updated_at timestamp"


def config_hash(config: dict) -> str:
    """Digest of the settings a resumed run must share."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Registry:
    """Runs as an append-only table; the newest row of a run counts.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(RUNS).parquet(self.path)
        except Exception as x:  # no run yet
            if "PATH_NOT_FOUND" not in str(x):
                raise
            rows = self.spark.createDataFrame([], RUNS)
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), "updated_at").alias("r")).select("r.*")

    def get(self, run_id: str) -> dict | None:
        row = self.runs().where(F.col("run_id") == run_id).first()
        return row.asDict() if row else None

    def _append(self, run_id: str, status: str, seeds: list[str], digest: str, config: str, created) -> None:
        row = self.spark.createDataFrame([(run_id, status, seeds, digest, config, created)], "run_id string, status string, seeds array<string>, config_hash string, config string, created_at timestamp")
        now = F.current_timestamp()
        row.withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now).write.mode("append").parquet(self.path)

    def start(self, run_id: str, seeds: list[str], config: dict, resume: bool = False, allow_mismatch: bool = False) -> dict:
        """Create a run, or take up an old one: ids are not used twice, and what makes a crawl what it is must not change."""
        old, digest = self.get(run_id), config_hash(config)
        if resume:
            if old is None:
                raise ValueError(f"there is no run {run_id}")
            if old["config_hash"] and old["config_hash"] != digest and not allow_mismatch:
                raise ValueError(f"run {run_id} was made with other seeds or scope")
        elif old is not None:
            raise ValueError(f"there is a run {run_id} already")
        self._append(run_id, "running", seeds, digest, json.dumps(config, sort_keys=True), old["created_at"] if old else None)
        return self.get(run_id)

    def set_status(self, run_id: str, status: str) -> None:
        old = self.get(run_id)
        if old is None:
            raise ValueError(f"there is no run {run_id}")
        self._append(run_id, status, old["seeds"], old["config_hash"], old["config"], old["created_at"])


def runs_with_counts(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs, newest first, with their pages; a ``legacy`` run without pages is left out."""
    n = pages.groupBy("run_id").agg(F.count("*").alias("urls"), F.count_if(F.col("kind") == "html").alias("html"))
    met = runs.join(n, "run_id", "left").na.fill(0, ["urls", "html"])
    return met.where("run_id <> 'legacy' or urls > 0").orderBy(F.desc("created_at"), "run_id")


def job_summary(results: DataFrame) -> DataFrame:
    """One row: crawled, blocked, failed, redirected and stored results, with a verdict on durability."""
    ok = F.col("skip_reason").isNull()
    out = results.agg(
        F.count("*").alias("results"), F.count_if(ok & (F.col("status") > 0)).alias("crawled"), F.count_if(~F.col("allowed_by_robots")).alias("blocked"), F.count_if(F.col("status") >= 400).alias("failed"),
        F.count_if(F.col("requested_url") != F.col("final_url")).alias("redirected"), F.count_if(F.col("challenge").isNotNull()).alias("challenged"), F.count("persist_error").alias("not_stored"),
    )
    return out.withColumn("durability", F.when(F.col("not_stored") == 0, "complete").when(F.col("not_stored") < F.col("crawled"), "partial").otherwise("none"))
