import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.sources import readers, sinks
from webloom.sources.store import Store

PAGE = """<html><head><meta name="robots" content="noindex, nofollow"><link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"></head>
<body><a href="/x">X</a><a href="/y">Y</a><div itemscope></div></body></html>"""


def snapshots(spark, run):
    return spark.createDataFrame([(run, 1, "ab\u00e4", "h1"), (run, 2, None, None)], "run_id string, url_id long, html string, content_hash_sha256 string")


def test_write_replace_delete_and_compact(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.tables() == [] and store.counts().count() == 0
    for run in ("a/1", "b"):
        store.write("snapshots", snapshots(spark, run))
    store.write("snapshots", snapshots(spark, "b").where("url_id = 1"))
    store.write("embeddings", spark.createDataFrame([("b", 1, [0.5])], "run_id string, url_id long, vector array<double>"))
    assert {tuple(r) for r in store.counts().collect()} == {("snapshots", "a/1", 2), ("snapshots", "b", 1), ("embeddings", "b", 1)}
    assert {r.run_id: (r.pages, r.with_html, r.html_bytes) for r in store.html_storage().collect()} == {"a/1": (2, 1, 4), "b": (1, 1, 4)}
    assert store.compact_run("a/1") == 4 and store.compact_run("a/1") == 0
    assert {r.run_id: r.html_bytes for r in store.html_storage().collect()} == {"a/1": 0, "b": 4} and store.read("snapshots", "a/1").count() == 2
    assert store.delete_run("b") == ["snapshots", "embeddings"] and store.delete_run("a/1") == ["snapshots"]
    with pytest.raises(ValueError):
        store.delete_run("b")
    with pytest.raises(ValueError):
        store.write("pages", snapshots(spark, "x"))
    with pytest.raises(ValueError):
        store.write("snapshots", snapshots(spark, None))
    store.write("snapshots", snapshots(spark, "c").withColumn("content_hash_sha256", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        store.compact_run("c")


def test_facts_in_their_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://h/p", PAGE), (2, "https://h/q", None)], "url_id long, url string, html string")
    store = Store(spark, str(tmp_path / "store"))
    store.write_facts(html.extract_pages(pages).withColumn("run_id", F.lit("r")))
    rows = lambda name, *c: sorted(tuple(r) for r in store.read(name).where("url_id = 1").select(*c).collect())
    assert rows("directives", "source", "directive") == [("meta", "nofollow"), ("meta", "noindex")] and rows("canonicals", "source", "href") == [("html", "https://h/c")]
    assert rows("alternates", "hreflang", "href") == [("de", "https://h/de")] and rows("links", "place", "href") == [(0, "https://h/x"), (1, "https://h/y")]
    assert rows("schema_items", "type", "raw_data") == [("BrokenMicrodata", '<div itemscope=""></div>')] and store.read("links").where("url_id = 2").count() == 0


def test_crawl_lines_end_with_a_summary(spark, tmp_path):
    out = str(tmp_path / "crawl")
    sinks.write_crawl(spark.createDataFrame([("https://h/a", 200)], "requested_url string, status int"), out, {"n": 1})
    assert json.loads((tmp_path / "crawl" / "summary.json").read_text()) == {"__type": "summary", "n": 1}
    assert [r.requested_url for r in readers.read_crawl(spark, out).collect()] == ["https://h/a"]
