"""Audit reports over page snapshots and link rows, each a plain query for the optimiser.

Pages have the columns of ``webloom.sources.schemas.SNAPSHOT``; a report needs only the columns it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import netloc_of


def one_run(pages: DataFrame, run_id: str | None = None) -> DataFrame:
    """The rows of one run; without an id there must be exactly one, as a report never guesses."""
    if run_id is None:
        runs = [r.run_id for r in pages.select("run_id").distinct().limit(2).collect()]
        if len(runs) != 1:
            raise ValueError("name the run: there is " + ("none" if not runs else "more than one"))
        run_id = runs[0]
    return pages.where(F.col("run_id") == run_id)


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """html pages no entry of the frontier names a parent for; seeds count as orphans.  links: run_id, url_id, parent_id."""
    with_parent = links.where("parent_id is not null").select("run_id", "url_id")
    return pages.where("kind = 'html'").join(with_parent, ["run_id", "url_id"], "left_anti").select("run_id", "url_id", "url").distinct()


def hub_pages(links: DataFrame, least: int = 5) -> DataFrame:
    """(run_id, parent_id, outlinks) of parents with many children."""
    return links.where("parent_id is not null").groupBy("run_id", "parent_id").agg(F.count("*").alias("outlinks")).where(F.col("outlinks") >= least)


def redirects(pages: DataFrame) -> DataFrame:
    return pages.where("url <> final_url").select("run_id", F.col("url").alias("requested_url"), "final_url", "initial_status_code", "final_status_code")


def slowest(pages: DataFrame, n: int = 50) -> DataFrame:
    rows = pages.where("total_duration_seconds is not null").select("url", "ttfb_seconds", "total_duration_seconds", "final_status_code")
    return rows.orderBy(F.desc("total_duration_seconds"), "url").limit(n)


def worst_vitals(pages: DataFrame, n: int = 50) -> DataFrame:
    rows = pages.where("lcp_ms is not null or cls is not null or inp_ms is not null").select("url", "lcp_ms", "cls", "inp_ms", "final_status_code")
    return rows.orderBy(F.desc_nulls_last("lcp_ms"), F.desc_nulls_last("cls"), "url").limit(n)


def overview(pages: DataFrame) -> DataFrame:
    """Counts of a run with their percentages, one row per label."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    code = lambda n: F.col("final_status_code").between(n * 100, n * 100 + 99)
    html = F.col("kind") == "html"
    tests = {
        "total": F.lit(True), "indexable": F.col("overall_indexable"), "https": F.col("url").startswith("https://"), "c2xx": code(2), "c3xx": code(3), "c4xx": code(4), "c5xx": F.col("final_status_code") >= 500,
        "html": html, "missing_title": html & blank("title"), "missing_meta": html & blank("meta_description"), "missing_h1": html & blank("h1_tags"),
    }
    wide = pages.groupBy("run_id").agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in tests)))
    return wide.select("run_id", "total", long.alias("x")).select("run_id", "x.label", "x.n", F.round(F.col("x.n") * 100 / F.col("total"), 1).alias("pct"))


def hits(pages: DataFrame) -> DataFrame:
    """Exploded vendor hits: run_id, url_id, url and the fields of the hit."""
    return pages.select("run_id", "url_id", "url", "fetched_at", F.explode("analytics").alias("hit")).select("run_id", "url_id", "url", "fetched_at", "hit.*")


def vendor_inventory(pages: DataFrame) -> DataFrame:
    return hits(pages).groupBy("run_id", "vendor", "category", "identifier").agg(F.countDistinct("url_id").alias("page_count"))


def pages_without_vendor(pages: DataFrame, vendor: str | None = None) -> DataFrame:
    """html pages without a hit, or without one of the vendor."""
    test = F.size("analytics") == 0 if vendor is None else ~F.exists("analytics", lambda h: h["vendor"] == vendor)
    return pages.where("kind = 'html'").where(F.coalesce(test, F.lit(True))).select("run_id", "url")


def pages_without_identifier(pages: DataFrame, identifier: str) -> DataFrame:
    return pages.where("kind = 'html'").where(F.coalesce(~F.exists("analytics", lambda h: h["identifier"] == identifier), F.lit(True))).select("run_id", "url")


def sitemap_pages(pages: DataFrame) -> DataFrame:
    """Addresses for a sitemap: html, 200, not kept out of indexes, no canonical but their own."""
    own = ~F.exists("canonical_urls", lambda c: c != F.col("url"))
    good = (F.col("kind") == "html") & (F.col("final_status_code") == 200) & F.coalesce("overall_indexable", F.lit(True)) & F.coalesce(own, F.lit(True))
    return pages.where(good).select("run_id", "url").distinct()


def link_counts(links: DataFrame) -> DataFrame:
    """Inlinks and outlinks of each address.  links: run_id, source, target."""
    edges = links.where("source is not null and target is not null").select("run_id", "source", "target").distinct()
    out = edges.groupBy("run_id", F.col("source").alias("url")).agg(F.count("*").alias("outlinks"), F.count_if(netloc_of(F.col("source")) != netloc_of(F.col("target"))).alias("external"))
    into = edges.groupBy("run_id", F.col("target").alias("url")).agg(F.count("*").alias("inlinks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, ["run_id", "url"], "full_outer").select("run_id", "url", zero("inlinks"), zero("outlinks"), zero("external"))


def frontier_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def next_batch(entries: DataFrame, now: int, n: int) -> DataFrame:
    """The entries to claim next: queued and due, by priority, then by age."""
    due = entries.where("status = 'queued'").where(F.coalesce("retry_at", F.lit(0)) <= now)
    return due.orderBy(F.desc_nulls_last("priority_score"), "enqueued_at", "run_id", "url_id").limit(n)


def stale(pages: DataFrame, wanted: DataFrame, now: int, days: int) -> DataFrame:
    """The wanted addresses that no good fetch of the last days covers."""
    fresh = pages.where(F.col("final_status_code") == 200).where(F.col("fetched_at") >= now - days * 86_400).select("url").distinct()
    return wanted.select("url").distinct().join(fresh, "url", "left_anti")


def archive_gaps(archived: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, legacy): archived addresses nobody crawled, and those that now fail or lead elsewhere."""
    old = archived.select("url").where("url is not null").distinct()
    missing = old.join(known.select("url"), "url", "left_anti")
    bad = known.where("final_status_code >= 400 or url <> final_url").select("url", "final_url", "final_status_code").distinct()
    return missing, old.join(bad, "url")
