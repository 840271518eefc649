"""Pages that compete for one intent: similar pairs, risks, clusters and what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.text import is_thin, word_count
from webloom.functions.urls import in_section, lang_bucket, path_depth, section_of, time_sequenced, url_relation
from webloom.operators.ranks import numbered
from webloom.operators.similarity import ann_pairs, cluster_cohesion, complete_linkage, cosine_pairs, single_linkage, usable
from webloom.scratch import Scratch

# Labels of the reports.
DUPLICATE = "duplicate — decanonicalisation likely"
PARENT_CHILD = "parent-child overlap — differentiate or consolidate deliberately"
HIGH = "high intent overlap"
SEQUENCED = "topical overlap (time-sequenced) — review editorially; consider hub or internal linking"
THIN = "thin content — add distinguishing content"


def prepared(records: DataFrame, lang_split: bool = True, thin_words: int = 88) -> DataFrame:
    """Records of a usable vector with part (run, language and, if there, embedding_model), thin flag and the names used here.

    records: run_id, url_id, url, vector, hreflang_group, hreflang_code, word_count, signal_confidence,
    signature_model_input and, if vectors of several models may occur, embedding_model.
    """
    lang = lang_bucket(F.col("hreflang_code")) if lang_split else F.lit("all")
    model = [F.coalesce("embedding_model", F.lit(""))] if "embedding_model" in records.columns else []
    part = F.concat_ws("/", "run_id", lang, *model)
    return records.where(usable(F.col("vector"))).select(
        part.alias("part"), "run_id", F.col("url_id").alias("id"), "url", "vector", "hreflang_group", "hreflang_code", F.coalesce("word_count", F.lit(0)).alias("words"), "signal_confidence",
        is_thin(F.col("signature_model_input"), thin_words).alias("thin"), word_count(F.col("signature_model_input")).alias("signature_words"),
    )


def primary_only(records: DataFrame, primary: str = "en") -> DataFrame:
    """One page per language group of a run, that of the primary language or else the shortest address; others pass."""
    rank = F.row_number().over(Window.partitionBy("run_id", "hreflang_group").orderBy((lang_bucket(F.col("hreflang_code")) != primary).cast("int"), F.length("url"), "url"))
    grouped = records.where("hreflang_group is not null").withColumn("rank", rank).where("rank = 1").drop("rank")
    return grouped.unionByName(records.where("hreflang_group is null"))


def overlap_pairs(pages: DataFrame, least: float = 0.85, suppress: bool = True, sections: list[str] = (), approximate: bool = False) -> DataFrame:
    """Pairs of similar pages of a part: relation of addresses, thinness, confidence and class.  pages: ``prepared``."""
    attributes = ["url", "hreflang_group", "signal_confidence", "thin"]
    ends = {s: pages.select("part", F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in attributes)) for s in "ab"}
    met = (ann_pairs if approximate else cosine_pairs)(pages, least).join(ends["a"], ["part", "a"]).join(ends["b"], ["part", "b"])
    if suppress:
        met = met.where(~F.coalesce(F.col("hreflang_group_a") == F.col("hreflang_group_b"), F.lit(False)))
    thin = F.when(F.col("thin_a") & F.col("thin_b"), "both").when(F.col("thin_a") | F.col("thin_b"), "asymmetric").otherwise("")
    low = F.coalesce(F.col("signal_confidence_a") == "low", F.lit(False)) | F.coalesce(F.col("signal_confidence_b") == "low", F.lit(False))
    a, b = F.col("url_a"), F.col("url_b")
    return met.select("part", "a", "b", "sim", "url_a", "url_b", low.alias("low_confidence"), url_relation(a, b).alias("relation"), section_of(a).alias("section_a"), section_of(b).alias("section_b"), thin.alias("thin"), time_sequenced(a, b, list(sections)).alias("pair_class"))


def page_risks(pages: DataFrame, pairs: DataFrame, duplicate: float = 0.92) -> DataFrame:
    """(part, id, max_similarity, nearest_id, risk) of every page; without pairs 0, null and ''."""
    one = lambda me, other: pairs.select("part", F.col(me).alias("id"), F.col(other).alias("other"), "sim", "relation", "thin", "pair_class")
    edges = one("a", "b").unionByName(one("b", "a"))
    dup, timed = F.col("sim") >= duplicate, F.col("pair_class") != ""
    flags = edges.groupBy("part", "id").agg(
        F.max("sim").alias("max_sim"), F.min(F.struct(-F.col("sim"), "other"))["other"].alias("nearest_id"), F.bool_or(dup).alias("dup"), F.bool_or(dup & (F.col("thin") != "both")).alias("rich"),
        F.bool_or(dup & ~timed).alias("plain_dup"), F.bool_and(F.when(dup & ~timed, F.col("relation") == "parent-child")).alias("hub"), F.bool_or(~timed).alias("plain"), F.bool_or(timed).alias("timed"),
    )
    risk = F.when(F.col("dup") & ~F.col("rich"), THIN).when(F.col("plain_dup"), F.when(F.col("hub"), PARENT_CHILD).otherwise(DUPLICATE)).when(F.col("plain"), HIGH).when(F.col("timed"), SEQUENCED)
    met = pages.select("part", "id").join(flags, ["part", "id"], "left")
    return met.select("part", "id", F.round(F.coalesce("max_sim", F.lit(0.0)), 4).alias("max_similarity"), "nearest_id", F.coalesce(risk, F.lit("")).alias("risk"))


def clusters(pages: DataFrame, pairs: DataFrame, linkage: str = "single", least: float = 0.85) -> DataFrame:
    """(part, id, cluster) by single or complete linkage."""
    return single_linkage(pairs) if linkage == "single" else complete_linkage(pairs, pages, least)


def cluster_rows(pages: DataFrame, pairs: DataFrame, members: DataFrame, least: float = 0.85, sections: list[str] = ()) -> DataFrame:
    """One row per cluster: size, relation, languages, words, cohesion, whether chained or thin, and the page to keep."""
    scratch = Scratch(pages.sparkSession)
    members = scratch.cut(members, "members")
    inside = pairs.join(members.withColumnRenamed("id", "a"), ["part", "a"]).join(members.select("part", F.col("id").alias("b"), F.col("cluster").alias("c")), ["part", "b"]).where("cluster = c")
    relation = inside.groupBy("part", "cluster").agg(F.min("relation").alias("r"), F.max("relation").alias("s")).select("part", "cluster", F.when(F.col("r") == F.col("s"), F.col("r")).otherwise("mixed").alias("relation"))
    m = members.join(pages.drop("vector"), ["part", "id"])
    words_first = F.struct(-F.col("words"), F.length("url"), "url")
    hub_first = F.struct(path_depth(F.col("url")), F.length("url"), "url")
    section = F.lit(None).cast("string")
    tests = {s: F.bool_and(in_section(F.col("url"), s)) for s in sections}
    stats = m.groupBy("part", "cluster").agg(
        F.min(words_first)["url"].alias("longest"), F.min(hub_first)["url"].alias("hub"), F.floor(F.avg("words")).cast("int").alias("avg_word_count"), F.bool_and("thin").alias("thin"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("hreflang_code") != "", lang_bucket(F.col("hreflang_code"))))), ",").alias("languages"), *(t.alias(f"in:{s}") for s, t in tests.items()),
    )
    for s in reversed(list(sections)):
        section = F.when(F.col(f"`in:{s}`"), "/" + s.strip().lower().strip("/")).otherwise(section)
    cohesion = cluster_cohesion(members, pages)
    chained = F.round("min_sim", 10) < least
    keep: Column = (
        F.when(chained, "review — chained cluster").when(F.col("thin"), "review — thin content; add distinguishing content")
        .when(section.isNotNull(), F.concat(F.lit("review — time-sequenced section ("), section, F.lit("); suggest hub/roundup page"))).when(F.col("relation") == "parent-child", F.col("hub")).otherwise(F.col("longest"))
    )
    out = cohesion.join(stats, ["part", "cluster"]).join(relation, ["part", "cluster"], "left")
    return out.select("part", "cluster", "size", keep.alias("suggested_canonical"), F.coalesce("relation", F.lit("")).alias("relation"), "languages", "avg_word_count", "thin", F.round("min_sim", 4).alias("min_intra_sim"), F.round("mean_sim", 4).alias("mean_intra_sim"), F.round("cohesion", 4).alias("cohesion"), chained.alias("chained"))


def named_clusters(rows: DataFrame, prefix: str = "C") -> DataFrame:
    """rows with cluster_id, numbered over all parts by part and smallest member."""
    ids = numbered(rows.select(F.struct("part", "cluster").alias("key")).distinct(), "key", "k").select("key.part", "key.cluster", F.format_string(f"{prefix}%04d", "k").alias("cluster_id"))
    return rows.join(ids, ["part", "cluster"])


def distinguishing_terms(members: DataFrame, text: str, n: int = 3, stop: list[str] = ()) -> DataFrame:
    """(part, cluster, terms): the most frequent words of a cluster's pages that not all of them have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{3,})"), 1))
    each = members.select("part", "cluster", "id", F.explode(words).alias("term")).where(~F.col("term").isin(list(stop))) if stop else members.select("part", "cluster", "id", F.explode(words).alias("term"))
    counts = each.groupBy("part", "cluster", "term").agg(F.count("*").alias("df"))
    sizes = members.groupBy("part", "cluster").agg(F.count("*").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("part", "cluster").orderBy(F.desc("df"), "term"))
    top = counts.join(sizes, ["part", "cluster"]).where("df < pages").withColumn("rank", rank).where(F.col("rank") <= n)
    return top.groupBy("part", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))


def shared_prefix(members: DataFrame) -> DataFrame:
    """(part, cluster, prefix): the path segments all addresses of a cluster begin with, from its least and greatest."""
    from webloom.functions.urls import path_segments

    ends = members.select("part", "cluster", path_segments(F.col("url")).alias("s")).groupBy("part", "cluster").agg(F.min("s").alias("x"), F.max("s").alias("y"))
    same = F.zip_with("x", "y", lambda a, b: F.coalesce(a == b, F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")
    return ends.select("part", "cluster", F.concat(F.lit("/"), F.array_join(F.slice("x", 1, n), "/")).alias("prefix"))
