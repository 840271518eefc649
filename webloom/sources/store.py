"""A crawl store: normalised tables in partitions by run, which is what replaces, deletes and compacts work on."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.scratch import Scratch
from webloom.sources import files

TABLES = ("snapshots", "directives", "canonicals", "alternates", "links", "schema_items", "embeddings", "signatures", "comparisons")


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """What ``extract_pages`` gives (with run_id) as one row per directive, canonical, alternate, link and schema item.

    ``place`` keeps the order on the page.  Empty lists and null addresses have no rows.
    """
    key = ["run_id", "url_id"]
    from_source = lambda c, s: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda d: F.struct(F.lit(s).alias("source"), d.alias("directive")))
    said = F.concat(from_source("meta_robots", "meta"), from_source("x_robots_tag", "header"))
    canonical = F.array(*(F.struct(F.lit(s).alias("source"), F.col(c).alias("href")) for c, s in (("canonical", "html"), ("x_canonical", "header"), ("amphtml", "amp"))))
    each = lambda array: facts.select(*key, F.posexplode(array).alias("place", "x")).select(*key, "place", "x.*")
    return {
        "directives": each(said), "canonicals": each(F.filter(canonical, lambda x: x["href"].isNotNull())),
        "alternates": each(F.col("hreflang")), "links": each(F.col("links")), "schema_items": each(F.col("schema")),
    }


class Store:
    """Tables below one folder.  Writing a run replaces it in that table and leaves other runs alone."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str) -> str:
        if name not in TABLES:
            raise ValueError(f"no table {name!r}")
        return f"{self.base}/{name}"

    def write(self, name: str, rows: DataFrame) -> None:
        """Rows with a run_id; those without one are an error, as no partition could name them."""
        if rows.where("run_id is null").limit(1).count():
            raise ValueError("some rows have no run_id")
        rows.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self._path(name))

    def write_facts(self, facts: DataFrame) -> None:
        facts = Scratch(self.spark).cut(facts, "facts")  # parsed once for five tables
        for name, rows in fact_tables(facts).items():
            self.write(name, rows)

    def tables(self) -> list[str]:
        return [t for t in TABLES if files.exists(self.spark, self._path(t))]

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self._path(name)).withColumn("run_id", F.col("run_id").cast("string"))
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    def counts(self) -> DataFrame:
        """(table_name, run_id, n) of all tables there are."""
        each = [self.read(t).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "run_id", "n") for t in self.tables()]
        return functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], "table_name string, run_id string, n long")

    def html_storage(self) -> DataFrame:
        """(run_id, pages, with_html, html_bytes) of the snapshots."""
        html = F.col("html")
        return self.read("snapshots").groupBy("run_id").agg(F.count("*").alias("pages"), F.count(html).alias("with_html"), F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).alias("html_bytes"))

    def delete_run(self, run_id: str) -> list[str]:
        """Delete a run from all tables; gives those that had it.  A run that no table has is an error."""
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        had = [t for t in TABLES if files.delete(self.spark, f"{self._path(t)}/run_id={name}")]
        if not had:
            raise ValueError(f"no run {run_id!r}")
        return had

    def compact_run(self, run_id: str) -> int:
        """Drop the html of a run's snapshots; gives the bytes freed.  Refuses while a page with html has no digest."""
        rows = self.read("snapshots", run_id)
        if rows.where("html is not null and content_hash_sha256 is null").limit(1).count():
            raise ValueError("some pages have html but no digest: compute the hashes first")
        freed = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first().n
        kept = Scratch(self.spark).cut(rows.withColumn("html", F.lit(None).cast("string")), "compacted")
        if freed:
            self.write("snapshots", kept)
        return freed
