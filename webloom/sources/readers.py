"""Readers: saved crawls, address lists, mappings, sitemaps, robots files, extraction rules."""

from __future__ import annotations

import gzip
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.detect import robots_rules
from webloom.sources.schemas import RESULT


def signed(h: Column) -> Column:
    """A 64-bit fingerprint written unsigned or signed, as the signed long."""
    big = T.DecimalType(20, 0)
    return F.when(h >= F.lit(str(1 << 63)).cast(big), h - F.lit(str(1 << 64)).cast(big)).otherwise(h).cast("long")


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Results of a saved crawl: one JSON document with ``results``, or a line each, whose summary line is left out.

    Missing fields are null, unknown ones ignored; fingerprints come out signed.
    """
    result = T.StructType.fromDDL(RESULT)
    whole = spark.read.schema(T.StructType([T.StructField("results", T.ArrayType(result))])).json(path, multiLine=True)
    rows = whole.where("results is not null").select(F.explode("results").alias("r")).select("r.*")
    if not rows.limit(1).count():
        lines = spark.read.schema(T.StructType([*result.fields, T.StructField("__type", T.StringType())])).json(path)
        rows = lines.where("__type is null and requested_url is not null").drop("__type")
    return rows.withColumn("content_hash_simhash", signed(F.col("content_hash_simhash")))


def snapshots(results: DataFrame, run_id: str, fetched_at: int) -> DataFrame:
    """Page snapshots of crawl results: what a page says belongs to its final address.

    overall_indexable needs status 200 and neither robots tag against it; a requested address that leads elsewhere gets
    a row of its own without content.
    """
    e = F.col("extracted")
    noindex = lambda c: F.coalesce(F.array_contains(c, "noindex"), F.lit(False))
    status = F.col("status")
    content = results.select(
        F.lit(run_id).alias("run_id"), F.xxhash64("final_url").alias("url_id"), F.col("final_url").alias("url"), F.lit("html").alias("kind"), "final_url", status.alias("initial_status_code"), status.alias("final_status_code"),
        F.lit(fetched_at).cast("long").alias("fetched_at"), e.title.alias("title"), e.meta_description.alias("meta_description"), F.array_join(F.try_element_at(e.headings, F.lit("h1")), "\n").alias("h1_tags"), e.word_count.alias("word_count"), e.html_lang.alias("html_lang"),
        "content_hash_sha256", "content_hash_simhash", ((status == 200) & ~noindex(e.meta_robots) & ~noindex(e.x_robots_tag)).alias("overall_indexable"), "challenge", "skip_reason", "ttfb_seconds", "total_duration_seconds", "lcp_ms", "cls", "inp_ms",
        F.array_compact(F.array(e.canonical, e.x_canonical)).alias("canonical_urls"), F.col("detected_analytics").alias("analytics"),
    )
    hops = results.where("requested_url <> final_url").select(F.lit(run_id).alias("run_id"), F.xxhash64("requested_url").alias("url_id"), F.col("requested_url").alias("url"), F.lit("html").alias("kind"), "final_url", status.alias("initial_status_code"), status.alias("final_status_code"), F.lit(fetched_at).cast("long").alias("fetched_at"))
    every = content.unionByName(hops, allowMissingColumns=True)
    # an answer without content never hides one with it
    best = F.max_by(F.struct(*every.columns), F.struct("title", "word_count", "content_hash_sha256"))
    return every.groupBy("run_id", "url_id").agg(best.alias("b")).select("b.*")


def read_urls(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Addresses of a CSV column, or of a plain list with # comments."""
    if column:
        return spark.read.csv(path, header=True).select(F.trim(column).alias("url")).where("url <> ''")
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def read_pairs(spark: SparkSession, path: str, source: str = "source_url", target: str = "target_url", note: str = "note") -> DataFrame:
    """line, source_url, target_url, note of a mapping with a header; see ``compare.first_pairs``."""
    rows = spark.read.csv(path, header=True)
    missing = {source, target} - set(rows.columns)
    if missing:
        raise ValueError(f"the mapping has no column {sorted(missing)}")
    line = F.monotonically_increasing_id() + 2  # in file order within a file; files have one header line
    return rows.select(line.alias("line"), F.col(source).alias("source_url"), F.col(target).alias("target_url"), (F.col(note) if note in rows.columns else F.lit(None).cast("string")).alias("note"))


def parse_sitemap(url: str, body: bytes, content_type: str | None = None) -> list[tuple[str, str, str | None, list[tuple[str, str]]]]:
    """(kind, loc, lastmod, [(hreflang, href)]) of a urlset, an index (kind sitemap) or a text list; broken XML gives none."""
    if url.lower().endswith(".gz") or "gzip" in (content_type or "").lower():
        try:
            body = gzip.decompress(body)
        except OSError:
            pass
    text = body.lstrip(b"\xef\xbb\xbf \r\n\t")
    if not text.startswith(b"<"):
        lines = (x.strip() for x in text.decode("utf-8", "replace").splitlines())
        return [("url", x, None, []) for x in lines if x.startswith(("http://", "https://"))]
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    kind = "sitemap" if local(root) == "sitemapindex" else "url"
    out = []
    for entry in root:
        if local(entry) != kind:
            continue
        named = {local(c): (c.text or "").strip() for c in entry}
        alternates = [(c.attrib["hreflang"], c.attrib["href"]) for c in entry if local(c) == "link" and c.attrib.get("rel") == "alternate" and c.attrib.get("hreflang") and c.attrib.get("href")]
        if named.get("loc"):
            out.append((kind, named["loc"], named.get("lastmod") or None, alternates))
    return out


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """source, kind, loc, lastmod, alternates of all sitemap files below a path; gzip is undone."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, loc, mod, [{"hreflang": h, "href": x} for h, x in alt]) for p, c in zip(pdf.path, pdf.content) for k, loc, mod, alt in parse_sitemap(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["source", "kind", "loc", "lastmod", "alternates"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "source string, kind string, loc string, lastmod string, alternates array<struct<hreflang: string, href: string>>")


def sitemap_levels(start: DataFrame, entries: DataFrame, depth: int = 3) -> DataFrame:
    """Addresses reached from the sitemaps ``start`` (loc) through indexes, with their level; each once, first level wins.

    entries: source, kind, loc.  Levels are few, so they are one plan.
    """
    frontier, seen, found = start.select("loc").distinct(), start.select("loc").distinct(), None
    for level in range(depth + 1):
        inside = entries.join(frontier.withColumnRenamed("loc", "source"), "source", "left_semi")
        here = inside.where("kind = 'url'").select("loc", F.lit(level).alias("level"))
        found = here if found is None else found.unionByName(here)
        frontier = inside.where("kind = 'sitemap'").select("loc").distinct().join(seen, "loc", "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy("loc").agg(F.min("level").alias("level"))


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """host, agent, kind, rule of files named <host>.txt or <host>/robots.txt below a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    host = F.regexp_extract("file", r"([^/]+?)(?:/robots)?\.txt$", 1)
    return files.select(host.alias("host"), F.explode(robots_rules(F.col("value"))).alias("r")).select("host", "r.*")


def load_rules(path: str) -> list[dict]:
    """Extraction rules of a JSON file: ``{"rules": [...]}`` or a bare list; each needs a name and a type."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rules = data.get("rules") if isinstance(data, dict) else data
    if not isinstance(rules, list) or any(not isinstance(r, dict) or not r.get("name") or r.get("type") not in ("css", "xpath", "regex") for r in rules):
        raise ValueError("rules need a name and a type of css, xpath or regex")
    return rules
