import gzip
import json

import pytest
from pyspark.sql import functions as F

from webloom.sources import readers, sinks
from webloom.streaming import frontier, windows
from webloom.streaming.run import drained

RESULT = {"requested_url": "https://h/a", "final_url": "https://h/b", "status": 200, "content_hash_simhash": 11490990246049860681, "extracted": {"title": "T", "meta_robots": [], "headings": {"h1": ["x", "y"]}, "word_count": 3, "canonical": "https://h/b"}, "unknown": 1}


def test_saved_crawls(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"results": [RESULT, {"requested_url": "https://h/c", "status": 404}]}))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in (RESULT, {"__type": "summary", "n": 1})))
    for name, n in (("doc.json", 2), ("lines.json", 1)):
        rows = readers.read_crawl(spark, str(tmp_path / name))
        assert rows.count() == n and rows.where("final_url is not null").first().content_hash_simhash == -6955753827659690935
    snap = {r.url: r for r in readers.snapshots(readers.read_crawl(spark, str(tmp_path / "lines.json")), "run", 7).collect()}
    assert snap["https://h/b"].title == "T" and snap["https://h/b"].overall_indexable and snap["https://h/b"].h1_tags == "x\ny" and snap["https://h/a"].title is None
    out = str(tmp_path / "store")
    both = readers.snapshots(readers.read_crawl(spark, str(tmp_path / "lines.json")), "run", 7)
    sinks.write_snapshots(both.unionByName(both), out)
    sinks.write_snapshots(both.withColumn("run_id", F.lit("other")), out)
    assert spark.read.parquet(out).groupBy("run_id").count().count() == 2 and spark.read.parquet(out).count() == 4


def test_lists_and_rules(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\nhttps://h/a\n\n https://h/b \n")
    (tmp_path / "u.csv").write_text("name,link\nx,https://h/c\ny,\n")
    assert [r.url for r in readers.read_urls(spark, str(tmp_path / "u.txt")).collect()] == ["https://h/a", "https://h/b"]
    assert [r.url for r in readers.read_urls(spark, str(tmp_path / "u.csv"), "link").collect()] == ["https://h/c"]
    (tmp_path / "p.csv").write_text("source_url,target_url\na,b\nc,d\n")
    assert [(r.line, r.source_url) for r in readers.read_pairs(spark, str(tmp_path / "p.csv")).collect()] == [(2, "a"), (3, "c")]
    with pytest.raises(ValueError):
        readers.read_pairs(spark, str(tmp_path / "u.csv"))
    (tmp_path / "r.json").write_text('[{"name": "a", "type": "regex", "pattern": "x"}]')
    assert readers.load_rules(str(tmp_path / "r.json"))[0]["name"] == "a"
    (tmp_path / "r.json").write_text('{"rules": [{"name": "a"}]}')
    with pytest.raises(ValueError):
        readers.load_rules(str(tmp_path / "r.json"))


def test_sitemaps(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml"'
    urlset = f'<?xml version="1.0"?><urlset {ns}><url><loc> https://h/a </loc><lastmod>2025</lastmod><xhtml:link rel="alternate" hreflang="de" href="https://h/de"/></url><url/></urlset>'.encode()
    assert readers.parse_sitemap("x.xml", urlset) == [("url", "https://h/a", "2025", [("de", "https://h/de")])]
    assert readers.parse_sitemap("x.xml.gz", gzip.compress(urlset)) == readers.parse_sitemap("x", urlset)
    assert readers.parse_sitemap("x", f"<sitemapindex {ns}><sitemap><loc>https://h/s</loc></sitemap></sitemapindex>".encode()) == [("sitemap", "https://h/s", None, [])]
    assert readers.parse_sitemap("x.txt", b"https://h/t\nnope\n") == [("url", "https://h/t", None, [])] and readers.parse_sitemap("x", b"<broken") == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_bytes(urlset)
    assert readers.read_sitemaps(spark, str(tmp_path / "in")).first().alternates[0].href == "https://h/de"
    entries = spark.createDataFrame([("i", "sitemap", "j"), ("j", "url", "u1"), ("j", "sitemap", "i"), ("i", "url", "u2"), ("k", "url", "u3")], "source string, kind string, loc string")
    got = {r.loc: r.level for r in readers.sitemap_levels(spark.createDataFrame([("i",)], "loc string"), entries).collect()}
    assert got == {"u1": 1, "u2": 0}
    urls = spark.createDataFrame([(f"https://h/{i:02d}?a&b",) for i in range(7)] * 2 + [(None,)], "url string")
    assert sinks.write_sitemap(urls, str(tmp_path / "out"), base="https://h/", per_file=3) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml", "sitemap.xml"]
    assert readers.parse_sitemap("x", (tmp_path / "out/sitemap-2.xml").read_bytes())[0][1] == "https://h/03?a&b"
    assert sinks.write_sitemap(urls.limit(0), str(tmp_path / "none")) == []
    sinks.write_reports({"urls": urls}, str(tmp_path / "rep"))
    assert json.loads((tmp_path / "rep/manifest.json").read_text())["urls"]["rows"] == 15
    with pytest.raises(ValueError):
        sinks.compact(spark.createDataFrame([("x", None)], "html string, content_hash_sha256 string"))


def test_queue_steps():
    s = None
    for event, at, want in (("enqueue", 1, "queued"), ("enqueue", 2, "queued"), ("claim", 3, "pending"), ("fail", 4, "queued"), ("claim", 5, "queued"), ("claim", 64, "pending"), ("reset", 65, "queued"), ("claim", 66, "pending"), ("done", 67, "done"), ("enqueue", 68, "done")):
        s = frontier.step(s, event, at)
        assert s[0] == want, (event, at, s)
    s = ("pending", 0, 0, 0, 0)
    for k in range(frontier.TRIES):
        s = frontier.step(("pending", *s[1:]), "fail", 10_000 * (k + 1))
    assert s[0] == "failed"
    b = ("closed", 0, 0)
    for k in range(5):
        b = frontier.breaker_step(b, False, k)
    assert b[0] == "open" and frontier.breaker_step(b, True, 10)[0] == "open" and frontier.breaker_step(b, True, 400) == ("closed", 0, 0) and frontier.breaker_step(b, False, 400)[0] == "open"


def test_streams_equal_batches(spark):
    ev = spark.sql("select timestamp_seconds(1700000000 + id * 700) as ts, id % 3 as user_id, if(id % 4 = 0, 'error', 'view') as event_type, id * 1.5 as value from range(60)")
    batch = {tuple(r) for r in windows.tumbling(ev).collect()}
    out = drained(spark, ev, windows.tumbling, "complete", files=3)
    last = out.agg(F.max("batch")).first()[0]
    assert {tuple(r) for r in out.where(F.col("batch") == last).drop("batch").collect()} == batch
    events = spark.createDataFrame([("r", 1, "enqueue", 1), ("r", 1, "claim", 2), ("r", 1, "done", 3), ("r", 2, "enqueue", 1), ("r", 2, "enqueue", 1)], "run_id string, url_id long, event string, at long")
    out = drained(spark, events, frontier.queue_states, "update").groupBy("run_id", "url_id").agg(F.max_by("status", "batch").alias("s"))
    assert {(r.url_id, r.s) for r in out.collect()} == {(1, "done"), (2, "queued")}
    seen = drained(spark, spark.createDataFrame([("r", "u"), ("r", "u"), ("s", "u")], "run_id string, url string"), frontier.new_urls)
    assert seen.count() == 2
