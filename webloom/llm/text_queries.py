from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import plain_host
from webloom.llm import languages, residue
from webloom.llm.records import records
from webloom.plans.tables import table


class ResidueFlags:
    """Which texts are residue, as a picklable function."""

    def __init__(self, model: residue.ResidueModel):
        self.model = model

    def __call__(self, texts: list[str]):
        return self.model.coverage(texts) >= residue.COVER


def _model(spark: SparkSession, d: str) -> residue.ResidueModel:
    raw = table(spark, d, "analysis_rows").select(plain_host(F.col("url")).alias("host"), "title", F.col("main_text").alias("text"))
    return residue.fit_on(raw, residue.notice_titles(table(spark, d, "soft404_probes"), raw))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "main_text").select(F.col("url_id").alias("id"), F.col("main_text").alias("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    covered = residue.residue_coverage(_texts(spark, d), _model(spark, d))
    return covered.where(F.col("coverage") >= residue.COVER).select(F.col("id").alias("url_id"))


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of residue, in records that are kept too."""
    found = residue.residue_lines(_texts(spark, d), _model(spark, d))
    return found.select(F.col("id").alias("url_id"), "line_no", F.round("coverage", 4).alias("coverage"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """(id, html, bucket) of each page; of several rows the one loaded last counts."""

    def last(name: str, column: str, alias: str) -> DataFrame:
        rows = table(spark, d, name).where("url_id is not null")
        return rows.groupBy(F.col("url_id").alias("id")).agg(F.max(F.struct("loaded_at", languages.code_of(F.col(column)).alias("code"))).alias("x")).select("id", F.col("x.code").alias(alias))

    return last("identity_pages", "html_lang", "html").join(last("hreflang_identity", "lang_bucket", "bucket"), "id", "full_outer")


def _labelled_texts(spark: SparkSession, d: str, labels: DataFrame) -> DataFrame:
    agreed = labels.where("html = bucket").select("id", F.col("html").alias("code"))
    raw = table(spark, d, "analysis_rows").select(F.col("url_id").alias("id"), F.col("main_text").alias("text"))
    # the sample is picked among ids first, so that few texts travel
    pick = F.row_number().over(languages.Window.partitionBy("code").orderBy(F.xxhash64("id"), "id"))
    few = agreed.withColumn("n", pick).where(F.col("n") <= 2 * languages.SAMPLE_PER_LANGUAGE).select("id", "code")
    return raw.join(few, "id")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each record and each foreign line."""
    labels = _labels(spark, d)
    model = languages.fit_on(_labelled_texts(spark, d, labels))
    return languages.languages_of(_texts(spark, d), model, ResidueFlags(_model(spark, d))).withColumnRenamed("id", "url_id").withColumn("confidence", F.round("confidence", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d).withColumnRenamed("id", "url_id")
    named = p6_languages(spark, d).join(labels, "url_id", "left")
    right = F.coalesce((F.col("html") == F.col("lang")) & (F.col("bucket") == F.col("lang")), F.lit(False))
    return named.where((F.col("line_no") > 0) | ~right).select("url_id", "line_no", "lang")


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages, "p7_found": p7_found, "p7_lines": p7_lines}
SQL: dict[str, str] = {}
