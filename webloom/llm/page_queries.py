from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.pages import page_bodies
from webloom.plans.tables import table


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the main body of each page, as text."""
    pages = table(spark, d, "signature_pages").select(F.col("url_id").alias("id"), "url", "html")
    texts = table(spark, d, "intent_signatures").select(F.col("url_id").alias("id"), "main_text", F.col("signal_confidence").alias("confidence"))
    return page_bodies(pages, texts).withColumnRenamed("id", "url_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).select("url_id", "field_name", F.md5("piece").alias("piece_md5"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL: dict[str, str] = {}
