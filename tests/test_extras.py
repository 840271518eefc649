import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, markup_rules, select
from webloom.operators import embeddings, runs
from webloom.sources import http as http_source
from webloom.sources import sinks

PAGE = "<div id=m class='a b'><p>one</p><p data-k='v1'>two <i>x</i></p><ul><li>1<li>2</li></ul></div><p class=b>three</p><a href='/q?x=1'>l</a>"


def picked(selector, kind=select.css):
    return [x if isinstance(x, str) else x.text(" ") for x in kind(selector)(html.parse(PAGE))]


def test_css():
    assert picked("p") == ["one", "two x", "three"] and picked("#m > p") == ["one", "two x"] and picked("div.a.b p[data-k^=v] i") == ["x"]
    assert picked("p + p") == ["two x"] and picked("div ~ p") == ["three"] and picked("p:first-child, a[href*='x=']") == ["one", "l"] and picked("p:nth-child(2)") == ["two x", "three"]
    for bad in ("", ">", "p:hover", "p >", "p("):
        with pytest.raises(ValueError):
            select.css(bad)


def test_xpath():
    assert picked("//p[2]", select.xpath) == ["two x"] and picked("//div[@id='m']/p[@data-k]/i", select.xpath) == ["x"] and picked("//a/@href", select.xpath) == ["/q?x=1"]
    assert picked("//p[contains(@class,'b')]/text()", select.xpath) == ["three"] and picked("//i/..", select.xpath) == ["two x"] and picked("//p[text()='one']", select.xpath) == ["one"]
    with pytest.raises(ValueError):
        select.xpath("//p[position() > 1]")


def test_custom_data(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "url_id long, html string")
    rules = [{"name": "ps", "type": "css", "selector": "p", "multiple": True}, {"name": "href", "type": "css", "selector": "a", "attr": "href"}, {"name": "k", "type": "xpath", "selector": "//p/@data-k"}, {"name": "n", "type": "regex", "pattern": r"x=(\d)"}, {"name": "none", "type": "css", "selector": "h9"}]
    got = {r.url_id: r.custom_data for r in select.custom_data(df, rules).collect()}
    assert got[1] == {"ps": "one\ntwox\nthree", "href": "/q?x=1", "k": "v1", "n": "1", "none": None} and set(got[2].values()) == {None}
    with pytest.raises(ValueError):
        select.custom_data(df, [{"name": "a", "type": "css", "selector": ">"}])


def test_broken_markup():
    page = '<script type="application/ld+json">{"@context":"https://schema.org","@type":</script><div itemscope></div><p typeof="X"></p><meta content="https://schema.org/A"><!-- http://schema.org/Thing --><script>var x={"@type":1}</script>'
    assert [x[1] for x in markup_rules.broken(html.parse(page))] == ["BrokenJSON-LD", "BrokenMicrodata", "BrokenRDFa", "BrokenMetaSchema", "BrokenCommentSchema", "BrokenScriptSchema"]


def test_embedding_jobs(spark):
    sig = spark.createDataFrame([(1, "a b", "h1"), (2, "c", "h2"), (3, "", "h3"), (4, None, "h4")], "url_id long, text string, signature_hash string")
    old = spark.createDataFrame([(1, "h1", "m"), (2, "h1", "m"), (2, "h2", "other")], "url_id long, signature_hash string, embedding_model string")
    todo = embeddings.pending(sig, old, "m")
    out = embeddings.embed(todo, embeddings.HashedWords(8), "m", 1).collect()
    assert [r.url_id for r in out] == [2] and abs(sum(x * x for x in out[0].embedding) - 1) < 1e-6
    assert embeddings.single_model(old.where("url_id = 1")) == "m" and embeddings.single_model(old.limit(0)) is None
    with pytest.raises(ValueError):
        embeddings.single_model(old)


def test_runs(spark, tmp_path):
    reg = runs.Registry(spark, str(tmp_path / "runs"))
    assert reg.get("a") is None
    assert reg.start("a", ["https://h"], {"scope": 1})["status"] == "running"
    for kw in ({}, {"resume": True, "config": {"scope": 2}}):
        with pytest.raises(ValueError):
            reg.start("a", ["https://h"], kw.pop("config", {"scope": 1}), **kw)
    with pytest.raises(ValueError):
        reg.start("b", [], {}, resume=True)
    reg.start("a", ["https://h"], {"scope": 2}, resume=True, allow_mismatch=True)
    reg.set_status("a", "done")
    assert reg.get("a")["status"] == "done" and reg.runs().count() == 1
    pages = spark.createDataFrame([("a", "html"), ("a", "pdf")], "run_id string, kind string")
    assert [(r.urls, r.html) for r in runs.runs_with_counts(reg.runs(), pages).collect()] == [(2, 1)]
    res = spark.createDataFrame([("u", "u", 200, None, True, None, None), ("v", "w", 404, None, True, None, "x"), ("x", "x", 0, "robots", False, None, None)], "requested_url string, final_url string, status int, skip_reason string, allowed_by_robots boolean, challenge string, persist_error string")
    s = runs.job_summary(res).first()
    assert (s.crawled, s.blocked, s.failed, s.redirected, s.durability) == (2, 1, 1, 1, "partial")


def test_report_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://h/</script>")], "id long, url string")
    pairs = spark.createDataFrame([(0.95, "a", "b", "sibling"), (0.86, "c", "d", "sibling")], "sim double, url_a string, url_b string, relation string")
    e = sinks.overlap_envelope(pages, pairs, pages.limit(0), {"run": "r"}, floor=1)
    assert e["summary"] == {"pages": 1, "pairs": 2, "pairs_told": 1, "truncated": True, "clusters": 0}
    sinks.write_html(spark, e, str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text()
    assert text.count("</script>") == 2 and json.loads(text.split('application/json">')[1].split("</script>")[0])["pages"][0]["url"] == "https://h/</script>"
    assert sinks.unpacked_html(sinks.packed_html("ä")) == "ä" == sinks.unpacked_html("ä".encode()) and sinks.unpacked_html(None) == ""


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/old":
            self.send_response(301)
            self.send_header("Location", "/new")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "image/png" if self.path == "/pic" else "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(("x" * 50 if self.path == "/big" else "<p>hällo</p>").encode())

    def log_message(self, *args):
        pass


def test_http_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        http_source.register(spark)
        urls = [f"{base}{p}" for p in ("/old", "/none", "/pic", "/big", "/old")] + ["ftp://h/x", "http://127.0.0.1:1/refused"]
        rows = {r.requested_url: r for r in spark.read.format("http_pages").option("urls", json.dumps(urls)).option("max_bytes", 20).load().collect()}
    finally:
        server.shutdown()
    assert len(rows) == 6
    old = rows[f"{base}/old"]
    assert old.status == 200 and old.final_url == f"{base}/new" and old.raw_html == "<p>hällo</p>" and [(h.url, h.status) for h in old.redirect_chain] == [(f"{base}/old", 301)]
    assert rows[f"{base}/none"].status == 404 and rows[f"{base}/pic"].raw_html is None and rows[f"{base}/big"].error == "too large" and rows["ftp://h/x"].error == "unsupported scheme" and rows["http://127.0.0.1:1/refused"].status == 0
