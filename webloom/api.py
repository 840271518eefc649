"""One function per command: tables in, tables or files out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, text
from webloom.functions.urls import netloc_of, normalise_url, remapped, replacements_from
from webloom.operators import compare, embeddings, identity, overlap, reports
from webloom.scratch import Scratch
from webloom.sources import http as http_source
from webloom.sources import readers, sinks


def fetch(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """Fetch addresses; see ``webloom.sources.http`` for the options."""
    http_source.register(spark)
    return spark.read.format("http_pages").options(**{k: str(v) for k, v in options.items()}).option("urls", json.dumps(urls)).load()


def extract(pages: DataFrame, **options: object) -> DataFrame:
    """Facts of fetched pages (requested_url, final_url, raw_html, headers)."""
    rows = pages.select(F.xxhash64("final_url").alias("url_id"), F.col("final_url").alias("url"), F.col("raw_html").alias("html"), "headers")
    return html.extract_pages(rows, **options)


def backfill_signatures(pages: DataFrame, share: float = text.SHARE) -> DataFrame:
    """Signature, digest, words and thinness of pages (url_id, url, title, h1, meta_description, main_text)."""
    p = pages.withColumn("site", netloc_of(F.col("url"))).join(text.title_boilerplate(pages.select("url", "title"), share), "site", "left")
    clean = lambda c: text.without_boilerplate(F.col(c), F.col("prefix"), F.col("suffix"))
    sig = text.signature_text(clean("title"), clean("h1"), F.col("meta_description"), F.col("main_text"))
    out = p.select("url_id", sig.alias("signature_model_input"))
    s = F.col("signature_model_input")
    return out.select("url_id", s, F.sha2(s, 256).alias("signature_hash"), text.word_count(s).alias("signature_words"), text.is_thin(s).alias("thin"))


def generate_embeddings(signatures: DataFrame, stored: DataFrame, encoder: Callable | None = None, model: str = "hashed-words-64") -> DataFrame:
    """Vectors of the signatures the model has none of; signatures: url_id, signature_model_input, signature_hash."""
    rows = signatures.select("url_id", F.col("signature_model_input").alias("text"), "signature_hash")
    return embeddings.embed(embeddings.pending(rows, stored, model), encoder or embeddings.HashedWords(), model)


def hreflang_identity(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """norm_url, group, language and bucket of each page (url_id, url, html_lang)."""
    groups = identity.hreflang_groups(edges)
    met = pages.withColumn("norm_url", normalise_url(F.col("url"))).join(groups, "norm_url", "left")
    code = identity.resolved_language(F.col("declared"), F.col("html_lang"))
    return met.select("url_id", "norm_url", "hreflang_group", code.alias("resolved_hreflang_code"), F.coalesce(F.lower(F.split_part(code, F.lit("-"), F.lit(1))), F.lit("unknown")).alias("lang_bucket"))


def intent_overlap(records: DataFrame, threshold: float = 0.85, duplicate: float = 0.92, linkage: str = "single", mode: str = "suppress", sections: list[str] = (), lang_split: bool = True, ann_min_pages: int = 10_000) -> dict[str, DataFrame]:
    """Tables pages, pairs and clusters of the records that take part in pairing.

    From ``ann_min_pages`` pages on pairs are found by an inverted file, whose recall is above 0.99 on pages that are alike.
    """
    if mode == "primary-only":
        records = overlap.primary_only(records)
    scratch = Scratch(records.sparkSession)  # pages and pairs are read several times
    pages = scratch.cut(overlap.prepared(records, lang_split), "pages")
    pairs = scratch.cut(overlap.overlap_pairs(pages, threshold, mode == "suppress", sections, approximate=pages.count() >= ann_min_pages), "pairs")
    members = overlap.clusters(pages, pairs, linkage, threshold)
    return {"pages": pages.drop("vector").join(overlap.page_risks(pages, pairs, duplicate), ["part", "id"]), "pairs": pairs, "clusters": overlap.cluster_rows(pages, pairs, members, threshold, sections)}


def compare_crawls(baseline: DataFrame, candidate: DataFrame, replace: list[str] = (), near: int = text.NEAR) -> DataFrame:
    return compare.compare_runs(baseline, candidate, replacements_from(list(replace)), near)


def rehashed(pages: DataFrame, replace: list[str], text_column: str = "text") -> DataFrame:
    """Pages (url_id, text) with digest and fingerprint of their text after replacements."""
    changed = pages.withColumn("changed", remapped(F.col(text_column), replacements_from(replace)))
    prints = text.simhash64(changed, "url_id", "changed")
    return changed.select("url_id", F.sha2("changed", 256).alias("content_hash_sha256")).join(prints.withColumnRenamed("simhash", "content_hash_simhash"), "url_id")


def compare_urls(pairs: DataFrame, pages: DataFrame, fail_on: str | None = None) -> tuple[DataFrame, bool]:
    """Verdict rows of a mapping, and whether the gate stops it."""
    rows = compare.pair_rows(pairs, pages)
    return rows, bool(fail_on) and compare.failing(rows, fail_on).limit(1).count() > 0


REPORTS = {
    "orphans": lambda pages, links: reports.orphan_pages(pages, links), "hubs": lambda pages, links: reports.hub_pages(links), "redirects": lambda pages, links: reports.redirects(pages), "slowest": lambda pages, links: reports.slowest(pages),
    "vitals": lambda pages, links: reports.worst_vitals(pages), "overview": lambda pages, links: reports.overview(pages), "missing-analytics": lambda pages, links: reports.pages_without_vendor(pages), "analytics": lambda pages, links: reports.vendor_inventory(pages),
    "indexability": lambda pages, links: pages.select("url", "html_meta_allows", "http_header_allows", "overall_indexable"),
}


def report(name: str, pages: DataFrame, links: DataFrame, run_id: str | None = None) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; there are {', '.join(sorted(REPORTS))}")
    return REPORTS[name](reports.one_run(pages, run_id), links)


def generate_sitemap(pages: DataFrame, folder: str, run_id: str | None = None, base: str = "") -> list[str]:
    """Write the sitemap of a run; no address to write is an error."""
    names = sinks.write_sitemap(reports.sitemap_pages(reports.one_run(pages, run_id)), folder, base=base)
    if not names:
        raise ValueError("no page is fit for a sitemap")
    return names


def load_crawl(spark: SparkSession, path: str, run_id: str, fetched_at: int) -> DataFrame:
    return readers.snapshots(readers.read_crawl(spark, path), run_id, fetched_at)


def soft_404(pages: DataFrame, probes: DataFrame, near: int = 8) -> DataFrame:
    """Pages (url, simhash) that look like their host's answer to a made-up address (tested_url, simhash)."""
    p = probes.where("simhash is not null").select(netloc_of(F.col("tested_url")).alias("host"), F.col("simhash").alias("probe")).distinct()
    met = pages.withColumn("host", netloc_of(F.col("url"))).join(p, "host")
    return met.where(text.hamming(F.col("simhash"), F.col("probe")) <= near).select("url").distinct()
