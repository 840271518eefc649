"""What an explorer of pages and pairs shows: labels, facets, filters and page windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import netloc_of, section_of

# Labels of answers.
STATUS_LABELS = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


def status_label(status: Column) -> Column:
    known = F.create_map(*(x for k, v in STATUS_LABELS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, status), F.lit(""))


def status_tone(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.between(300, 399), "warn").otherwise("bad")


def length_tone(length: Column, low: int, high: int) -> Column:
    """bad when empty, warn outside the wanted length, ok inside."""
    return F.when(F.coalesce(length, F.lit(0)) == 0, "bad").when((length < low) | (length > high), "warn").otherwise("ok")


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_external(url: Column, page: Column) -> Column:
    return netloc_of(url) != netloc_of(page)


def tabs() -> Column:
    """Sorted names of the tabs a page belongs to: kind, status, title, meta_description, h1_tags and canonical_urls decide."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    code = F.col("final_status_code")
    tests = {
        "response-codes": ~F.coalesce(code.between(200, 299), F.lit(False)), "titles": blank("title"), "descriptions": blank("meta_description"), "headings": blank("h1_tags"),
        "canonicals": F.coalesce(F.size("canonical_urls") != 1, F.lit(True)), "directives": ~F.coalesce("overall_indexable", F.lit(True)), "security": ~F.col("url").startswith("https://"),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items()))))


def filtered(pages: DataFrame, text: str = "", tab: str | None = None, failing: bool = False, fields: tuple[str, ...] = ("url", "title", "h1_tags")) -> DataFrame:
    """Pages whose fields hold the text, of one tab, or insecure and failing ones only."""
    if text:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(text.lower())), F.lit(False))
        pages = pages.where(hit)
    if tab:
        pages = pages.where(F.array_contains(tabs(), tab))
    if failing:
        pages = pages.where(~F.col("url").startswith("https://") | (F.col("final_status_code") >= 400))
    return pages


def pairs_filtered(pairs: DataFrame, least: float = 0.0, relation: str | None = None, text: str = "", hide_sequenced: bool = False) -> DataFrame:
    out = pairs.where(F.col("sim") >= least)
    if relation:
        out = out.where(F.col("relation") == relation)
    if text:
        out = out.where(F.contains(F.lower("url_a"), F.lit(text.lower())) | F.contains(F.lower("url_b"), F.lit(text.lower())))
    return out.where("pair_class = ''") if hide_sequenced else out


def risk_bucket(risk: Column) -> Column:
    return F.when(risk.startswith("duplicate"), "duplicate").when(risk.startswith("parent-child"), "parent-child").when(risk.startswith("high"), "overlap").when(risk.startswith("topical"), "time-sequenced").when(risk.startswith("thin"), "thin").otherwise("none")


def window_of(pages: DataFrame, limit: int = 5_000, offset: int = 0) -> DataFrame:
    """One window of the pages by address; 1 to 10,000 rows."""
    return pages.orderBy("url").offset(max(0, offset)).limit(min(10_000, max(1, limit)))


def site_structure(pages: DataFrame, n: int = 20) -> DataFrame:
    """The largest first path segments of each host."""
    return pages.groupBy(netloc_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host", "section").limit(n)
