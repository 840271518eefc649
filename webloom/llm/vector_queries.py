from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.records import records
from webloom.llm.vectors import nearest_neighbours


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "embedding_model", "embedding").select(F.col("url_id").alias("id"), F.col("embedding_model").alias("model"), "embedding")
    near = nearest_neighbours(rows, k=5, least=0.85)
    return near.select(F.least("id", "neighbour").alias("url_id_a"), F.greatest("id", "neighbour").alias("url_id_b")).distinct()


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
with recs as (
  select url_id, embedding_model as model, embedding as e from (
    select *, row_number() over (partition by run_id, url_id order by fetched_at desc nulls last, loaded_at desc) as pick from analysis_rows)
  where pick = 1 and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.url_id as a, b.url_id as b, list_cosine_similarity(a.e::double[], b.e::double[]) as sim
  from recs a join recs b on a.model is not distinct from b.model and len(a.e) = len(b.e) and a.url_id <> b.url_id),
best as (select a, b from pairs where sim >= 0.85 qualify row_number() over (partition by a order by sim desc, b) <= 5)
select distinct least(a, b) as url_id_a, greatest(a, b) as url_id_b from best"""
}
