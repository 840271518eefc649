"""Pages over HTTP as a batch data source: ``spark.read.format("http_pages").option("urls", …)``.

A partition is one host, so its delay and order hold without coordination.  Answers are cut at ``max_bytes``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import defaultdict
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "requested_url string, final_url string, status int, headers map<string, string>, content_type string, raw_html string, redirect_chain array<struct<url: string, status: int>>, total_duration_seconds double, error string"
TEXT = ("text/", "application/xhtml", "application/xml", "application/json")


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Hops(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.chain: list[tuple[str, int]] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.chain.append((req.full_url, code))
        return super().redirect_request(req, fp, code, msg, headers, newurl)


class HttpReader(DataSourceReader):
    """options: urls (JSON array), max_bytes, timeout, delay (seconds), user_agent, headers (JSON object)."""

    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.most, self.timeout, self.delay = int(options.get("max_bytes", 25_000_000)), float(options.get("timeout", 20)), float(options.get("delay", 0))
        self.headers = {"User-Agent": options.get("user_agent", "webloom/1"), **json.loads(options.get("headers", "{}"))}

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = defaultdict(list)
        for u in dict.fromkeys(self.urls):
            hosts[urlparse(u).netloc.lower()].append(u)
        return [HostPartition(us) for us in hosts.values()] or [HostPartition([])]

    def read(self, partition: HostPartition):
        for i, url in enumerate(partition.urls):
            if i and self.delay:
                time.sleep(self.delay)
            yield self.fetch(url)

    def fetch(self, url: str) -> tuple:
        hops, began = _Hops(), time.monotonic()
        if urlparse(url).scheme not in ("http", "https"):
            return (url, url, 0, {}, None, None, [], 0.0, "unsupported scheme")
        try:
            try:
                answer = urllib.request.build_opener(hops).open(urllib.request.Request(url, headers=self.headers), timeout=self.timeout)
            except urllib.error.HTTPError as x:
                answer = x
            with answer:
                kind = answer.headers.get_content_type()
                body = answer.read(self.most + 1) if kind.startswith(TEXT) else b""
                error = "too large" if len(body) > self.most else None
                text = body[: self.most].decode(answer.headers.get_content_charset() or "utf-8", "replace") if kind.startswith(TEXT) else None
                return (url, answer.geturl(), answer.status, dict(answer.headers.items()), kind, text, hops.chain, time.monotonic() - began, error)
        except (OSError, ValueError) as x:
            return (url, url, 0, {}, None, None, hops.chain, time.monotonic() - began, str(x)[:200])


def register(spark) -> None:
    spark.dataSource.register(HttpPages)
