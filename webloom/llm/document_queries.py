from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import abuse
from webloom.llm.leakage import leaked_passages, without_leaks
from webloom.llm.mixing import mix_sources, token_counts
from webloom.plans.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item taints, and its longest passage."""
    leaks = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("most_words"), F.max("longest").alias("longest"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no passage of any item."""
    docs = table(spark, d, "documents")
    return without_leaks(docs, leaked_passages(docs, table(spark, d, "eval_items"))).select("doc_id", "source")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where each leaked passage lies in its document and its item, in words."""
    leaks = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.withColumn("share", F.round("share", 4))


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tokens and a quality weight: distinct words over words, at least 0.05."""
    words = F.split(F.lower("text"), r"\s+")
    weight = F.greatest(F.size(F.array_distinct(words)) / F.size(words), F.lit(0.05))
    docs = table(spark, d, "documents").select("doc_id", "source", "text", weight.alias("weight"))
    return token_counts(docs)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    _, report = mix_sources(_weighed(spark, d), table(spark, d, "mix_targets"))
    return report.withColumn("target_share", F.round("target_share", 6)).withColumn("actual_share", F.round("actual_share", 6))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document appears in each mix."""
    return mix_sources(_weighed(spark, d), table(spark, d, "mix_targets"))[0]


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of each document and category."""
    docs = table(spark, d, "documents")
    model = abuse.fit_on(docs, table(spark, d, "doc_labels"))
    out = abuse.abuse_scores(docs, model)
    return out.select("doc_id", "source", *(F.round(c, 4).alias(c) for c in abuse.CATEGORIES))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in abuse.CATEGORIES)))
    long = p10_scores(spark, d).select("doc_id", each.alias("x"))
    return long.where(F.col("x.score") >= abuse.LIMIT).select("doc_id", "x.category")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents per source and category."""
    return abuse.source_rates(p10_scores(spark, d))


QUERIES = {"p8_clean": p8_clean, "p8_found": p8_found, "p8_items": p8_items, "p8_passages": p8_passages, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_rates": p10_rates, "p10_scores": p10_scores}
SQL: dict[str, str] = {}
