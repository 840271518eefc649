"""Facts, vendors, rules and streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from webloom.functions import detect, html
from webloom.operators import compare, reports
from webloom.plans.tables import table
from webloom.streaming import frontier, windows
from webloom.streaming.run import drained


def _html(spark, d):
    return table(spark, d, "signature_pages").select("url_id", "url", "html").distinct()


def html_titles(spark, d):
    facts = html.extract_pages(_html(spark, d)).select("url_id", "title", "html_lang", F.get("h1", F.lit(0)).alias("h1"))
    return facts.select("url_id", F.trim("title").alias("title"), "html_lang", "h1")


def html_facts(spark, d):
    """Sizes of what each page holds."""
    facts = html.extract_pages(_html(spark, d), any_host=True)
    return facts.select("url_id", "word_count", F.size("links").alias("n_links"), F.size("schema").alias("n_schema"), F.size("h2").alias("n_h2"), F.size("hreflang").alias("n_alternates"))


def html_links(spark, d):
    links = html.extract_pages(_html(spark, d)).select("url_id", F.explode("links").alias("l"))
    return links.select("url_id", "l.href", "l.anchor_text")


# The pages of the tables carry no scripts of vendors and no challenges: each page gets one of these marks by its id.
MARKS = [
    ('<script src="https://www.googletagmanager.com/gtm.js?id=GTM-AB12"></script><script>gtag("config", "G-XY9")</script>', 200, ""),
    ('<script src="/wp-content/themes/a.js"></script><script src="/wp-content/plugins/b.js"></script><script>fbq("init", "123");fbq("track", "x")</script>', 200, "_ga=GA1.2; path=/"),
    ("Just a moment... <script>window.__cf_chl_opt={}</script>", 503, ""),
    ("<p>please wait px-captcha</p>", 403, ""),
    ('<img src="https://cdn.shopify.com/s/x.png"><a href="/collections/a?variant=1">x</a>', 200, ""),
    ("<p>reference</p>", 403, "_abck=1"),
    ('<iframe src="https://geo.captcha-delivery.com/c"></iframe><script src="https://cdn.segment.com/analytics.js/v1/KEY1/analytics.min.js"></script>', 403, "_gid=2"),
    ('<script src="/_Incapsula_Resource?x"></script>gtag("config", "G-XY9") gtag("config", "G-ZZ1")', 200, ""),
    ("", 200, ""),
]


def _marked(spark, d):
    """Pages with a mark, a status and a cookie by their id."""
    k = F.pmod("url_id", F.lit(len(MARKS))).cast("int")
    of = lambda n: F.get(F.array(*(F.lit(m[n]) for m in MARKS)), k)
    rows = _html(spark, d).where("url_id is not null")
    return rows.select("url_id", "url", F.concat(F.coalesce("html", F.lit("")), of(0)).alias("html"), of(1).alias("status"), of(2).alias("cookie")).withColumn("headers", F.create_map(F.lit("Set-Cookie"), "cookie"))


def _plain(spark, d):
    """Pages as they are; the table has no cookies and no headers."""
    return _html(spark, d).select("url_id", "url", "html", F.lit("").alias("cookie"), F.lit(None).cast("map<string,string>").alias("headers"))


def _hits(pages):
    hits = pages.select("url_id", F.explode(detect.vendor_hits(F.col("html"), F.col("cookie"))).alias("h"))
    return hits.select("url_id", "h.vendor", F.coalesce("h.identifier", F.lit("")).alias("identifier"), "h.evidence_type", "h.confidence")


def _inventory(pages):
    rows = pages.select(F.lit("r").alias("run_id"), "url_id", "url", F.lit("html").alias("kind"), F.lit(1).alias("fetched_at"), detect.vendor_hits(F.col("html"), F.col("cookie")).alias("analytics"))
    return reports.vendor_inventory(rows).select("vendor", "category", F.coalesce("identifier", F.lit("")).alias("identifier"), "page_count")


def _systems(pages):
    out = pages.select("url_id", detect.detected_cms(F.col("html"), F.col("headers")).alias("c"))
    return out.select("url_id", F.coalesce("c.cms_name", F.lit("")).alias("cms"), "c.confidence")


def vendor_hits(spark, d):
    """Vendors of each page."""
    return _hits(_plain(spark, d))


def vendor_inventory(spark, d):
    return _inventory(_plain(spark, d))


def cms_detected(spark, d):
    """System of each page."""
    return _systems(_plain(spark, d))


def marked_vendor_hits(spark, d):
    """Vendors of each page with its mark."""
    return _hits(_marked(spark, d))


def marked_vendor_inventory(spark, d):
    return _inventory(_marked(spark, d))


def marked_cms_detected(spark, d):
    return _systems(_marked(spark, d))


def pages_without_vendor(spark, d):
    pages = _marked(spark, d).select(F.lit("r").alias("run_id"), "url", F.lit("html").alias("kind"), detect.vendor_hits(F.col("html"), F.col("cookie")).alias("analytics"))
    return reports.pages_without_vendor(pages, "ga4").select("url")


def challenges(spark, d):
    return _marked(spark, d).select("url_id", F.coalesce(detect.challenge(F.col("status"), F.col("headers"), F.col("html")), F.lit("")).alias("vendor"))


def custom_rules(spark, d):
    """Headings and first paragraphs by user rules."""
    values = detect.custom_regex(F.col("html"), [{"name": "headings", "pattern": r"<h[123]>([^<>]+)</h[123]>", "multiple": True}, {"name": "first", "pattern": r"<p>([^<>]+)</p>"}])
    return _html(spark, d).select("url_id", F.coalesce(values["headings"], F.lit("")).alias("headings"), F.coalesce(values["first"], F.lit("")).alias("first"))


ROBOTS = "User-agent: *\nDisallow: /blog\nAllow: /blog/oak\nDisallow: /*?sku=\nDisallow: /*.htm$\nUser-agent: other\nDisallow: /"


def robots_decisions(spark, d):
    """One rule file for all hosts, over the addresses of the records."""
    from webloom.functions.urls import netloc_of, path_of, query_of

    u = F.col("url")
    rows = table(spark, d, "analysis_rows").where("url is not null").select(netloc_of(u).alias("host"), F.concat(path_of(u), F.when(query_of(u) != "", F.concat(F.lit("?"), query_of(u))).otherwise("")).alias("path")).distinct()
    rules = rows.select("host").distinct().select("host", F.explode(detect.robots_rules(F.lit(ROBOTS))).alias("r")).select("host", "r.*")
    return detect.robots_decisions(rows, rules, "loom/1").select("host", "path", "allowed", F.coalesce("matched_rule", F.lit("")).alias("matched_rule"))


def _answers(spark, d):
    """What each address of the pages answered, with the signature of its record."""
    pages = table(spark, d, "identity_pages").where("url is not null").select("run_id", "url_id", F.col("url").alias("requested_url"), "final_url", "status", "word_count").distinct()
    recs = table(spark, d, "analysis_rows").where("run_id is not null and url_id is not null").groupBy("run_id", "url_id").agg(F.max(F.struct("fetched_at", "loaded_at", "signature_hash"))["signature_hash"].alias("sha256"))
    hops = F.when(F.col("status").between(300, 399), F.array("status")).otherwise(F.array().cast("array<int>"))
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "h1", "meta_description")]
    return pages.join(recs, ["run_id", "url_id"], "left").select("requested_url", "final_url", "status", hops.alias("hops"), "sha256", F.lit(None).cast("long").alias("simhash"), *none, "word_count")


def _mapping(spark, d):
    """Each record's address should lead to its canonical address."""
    return table(spark, d, "analysis_rows").where("trim(url) <> '' and trim(canonical_url) <> ''").select(F.col("url").alias("source_url"), F.col("canonical_url").alias("target_url")).distinct()


def pair_verdicts(spark, d):
    out = compare.pair_rows(_mapping(spark, d), _answers(spark, d))
    return out.select("source_url", "target_url", "redirect_verdict", "n_hops", "sha256_equal", "content_verdict")


def pair_failures(spark, d):
    return compare.failing(pair_verdicts(spark, d), "any").select("source_url")


def events_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events"))


def events_sliding(spark, d):
    return windows.sliding(table(spark, d, "events"))


def events_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"))


def stream_tumbling(spark, d):
    """The tumbling windows of the event stream, complete mode."""
    out = drained(spark, table(spark, d, "events"), lambda s: windows.tumbling(s.select(F.col("ts").alias("ts"), "event_type", "value")), "complete")
    last = out.agg(F.max("batch").alias("batch"))  # one row
    return out.join(F.broadcast(last), "batch").drop("batch")


def stream_frontier(spark, d):
    """Final state of each queue entry after replaying the table as events."""
    f = table(spark, d, "frontier").where("run_id is not null and url_id is not null")
    event = F.explode(F.array(F.struct(F.lit("enqueue").alias("event"), F.coalesce("enqueued_at", F.lit(0)).alias("at")), F.struct(F.when(F.col("status") == "done", "done").otherwise("enqueue").alias("event"), F.coalesce("updated_at", "enqueued_at", F.lit(0)).alias("at"))))
    events = f.select("run_id", "url_id", event.alias("e")).select("run_id", "url_id", "e.event", "e.at")
    out = drained(spark, events, frontier.queue_states, "update")
    return out.groupBy("run_id", "url_id").agg(F.max_by("status", "batch").alias("status"))


def stream_breaker(spark, d):
    """State of a breaker per user over the error events."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("host"), (F.col("event_type") != "error").alias("ok"), F.unix_timestamp("ts").alias("at"))
    out = drained(spark, e, frontier.breaker_states, "update")
    return out.groupBy("host").agg(F.max_by("state", "batch").alias("state"))


def events_props(spark, d):
    """Events by a key of their JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        html_titles, html_facts, html_links, vendor_hits, vendor_inventory, marked_vendor_hits, marked_vendor_inventory, pages_without_vendor, cms_detected, marked_cms_detected, challenges, custom_rules, robots_decisions, pair_verdicts, pair_failures, events_tumbling, events_sliding, events_sessions,
        stream_tumbling, stream_frontier, stream_breaker, events_props,
    )
}

_Q = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
_OF = lambda n: f"([{', '.join(_Q(m[n]) for m in MARKS)}])[url_id % {len(MARKS)} + 1]"
_MARKED = f"pg as (select url_id, url, coalesce(html, '') || {_OF(0)} as html, {_OF(1)} as status, {_OF(2)} as cookie from (select distinct url_id, url, html from signature_pages where url_id is not null))"
_PLAIN = "pg as (select distinct url_id, url, coalesce(html, '') as html, '' as cookie from signature_pages)"
_HITS = f"""every as ({" union all ".join(f"select url_id, {_Q(v)} as vendor, {_Q(c)} as category, {_Q(e)} as evidence_type, {conf} as confidence, {f'regexp_extract(m, {_Q(p)}, 1)' if re.compile(p).groups else 'null'} as identifier from (select url_id, unnest(regexp_extract_all({'cookie' if e == 'cookie' else 'html'}, {_Q(p)})) as m from pg)" for v, c, e, p, conf in detect.VENDOR_RULES)}),
hits as (select url_id, vendor, category, coalesce(identifier, '') as identifier, evidence_type, max(confidence)::double as confidence from every group by 1, 2, 3, 4, 5)"""
_KEYED = lambda u: rf"lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(trim({u}), '//([^/?#]*)', 1)) || rtrim(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') || regexp_extract(trim({u}), '^[^?#]*(.*)$', 1)"
_PAIR = f"""n as (select run_id, url_id, signature_hash as sha from (select *, row_number() over (partition by run_id, url_id order by fetched_at desc nulls last, loaded_at desc nulls last, signature_hash desc nulls last) as k from analysis_rows) where k = 1),
a as (select p.url as req, p.final_url as fin, p.status, n.sha, p.word_count as wc from (select distinct run_id, url_id, url, final_url, status, word_count from identity_pages where url is not null) p left join n using (run_id, url_id)),
asked as (select * from a qualify row_number() over (partition by req order by fin nulls first, status nulls first, sha nulls first, wc nulls first) = 1),
ended as (select * from a where fin is not null and fin not in (select req from asked) qualify row_number() over (partition by fin order by req, status nulls first, sha nulls first, wc nulls first) = 1),
t as (select req as k, sha from asked union all select fin, sha from ended),
p as (select distinct url as source_url, canonical_url as target_url from analysis_rows where trim(url) <> '' and trim(canonical_url) <> ''),
m as (select p.*, s.req, s.fin, s.status, s.sha as s_sha, t.sha as t_sha, s.req is not null as has_s, t.k is not null as has_t, coalesce(s.status between 300 and 399, false) as hop from p left join asked s on s.req = p.source_url left join t on t.k = p.target_url),
v as (select source_url, target_url, case when hop then 1 else 0 end as n_hops,
  case when not has_s then 'not_crawled' when status = 0 or status >= 400 then 'error_status'
    when not (hop or coalesce({_KEYED('fin')} <> {_KEYED('req')}, false)) then case when {_KEYED('source_url')} = {_KEYED('target_url')} then 'no_redirect_expected' else 'no_redirect' end
    when {_KEYED('fin')} <> {_KEYED('target_url')} then 'redirect_wrong_target' when status in (302, 303, 307) then 'redirect_temporary' else 'redirect_ok' end as redirect_verdict,
  case when has_s and has_t then s_sha is not distinct from t_sha end as sha256_equal,
  case when not (has_s and has_t) then 'missing' when s_sha is null or t_sha is null then 'unknown' when s_sha = t_sha then 'identical' else 'changed' end as content_verdict from m)"""
_TUMBLE = "select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2, 3"
_PATHQ = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) || case when regexp_extract(trim(url), '\?([^#]*)', 1) <> '' then '?' || regexp_extract(trim(url), '\?([^#]*)', 1) else '' end"
SQL = {
    "vendor_hits": f"with {_PLAIN}, {_HITS} select url_id, vendor, identifier, evidence_type, confidence from hits",
    "vendor_inventory": f"with {_PLAIN}, {_HITS} select vendor, category, identifier, count(distinct url_id) as page_count from hits group by 1, 2, 3",
    "marked_vendor_hits": f"with {_MARKED}, {_HITS} select url_id, vendor, identifier, evidence_type, confidence from hits",
    "marked_vendor_inventory": f"with {_MARKED}, {_HITS} select vendor, category, identifier, count(distinct url_id) as page_count from hits group by 1, 2, 3",
    "pages_without_vendor": f"with {_MARKED}, {_HITS} select url from pg where not exists (select 1 from hits where hits.url_id = pg.url_id and vendor = 'ga4')",
    "challenges": f"""with {_MARKED} select url_id, case when regexp_matches(lower(html), 'just a moment\\.\\.\\.|__cf_chl_|cf_chl_opt|challenges\\.cloudflare\\.com/turnstile') then 'cloudflare'
  when contains(lower(html), 'geo.captcha-delivery.com') or (contains(cookie, 'datadome') and status in (403, 429)) then 'datadome' when regexp_matches(lower(html), 'px-captcha|_px2|perimeterx|px\\.gif') and status in (403, 429) then 'perimeterx'
  when contains(cookie, '_abck') and status in (403, 429) then 'akamai' when contains(lower(html), '_incapsula_resource') then 'imperva' else '' end as vendor from pg""",
    "custom_rules": r"""select url_id, coalesce(array_to_string(regexp_extract_all(html, '<h[123]>([^<>]+)</h[123]>', 1), chr(10)), '') as headings, coalesce(regexp_extract(html, '<p>([^<>]+)</p>', 1), '') as first from (select distinct url_id, url, html from signature_pages)""",
    "robots_decisions": rf"""with u as (select distinct lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as host, {_PATHQ} as path from analysis_rows where url is not null)
select host, path, case when starts_with(path, '/blog/oak') and not regexp_matches(path, '^.*\?sku=') or not (starts_with(path, '/blog') or contains(path, '?sku=') or regexp_matches(path, '^/.*\.htm$')) then true when starts_with(path, '/blog/oak') then true else false end as allowed,
  case when starts_with(path, '/blog/oak') then 'Allow: /blog/oak' when contains(path, '?sku=') then 'Disallow: /*?sku=' when regexp_matches(path, '^/.*\.htm$') then 'Disallow: /*.htm$' when starts_with(path, '/blog') then 'Disallow: /blog' else '' end as matched_rule from u""",
    "pair_verdicts": f"with {_PAIR} select * from v",
    "pair_failures": f"with {_PAIR} select source_url from v where redirect_verdict in ('redirect_wrong_target', 'no_redirect', 'error_status', 'not_crawled') or content_verdict = 'changed'",
    "events_tumbling": _TUMBLE,
    "stream_tumbling": _TUMBLE,
    "events_sliding": """select s as window_start, s + interval '2 hours' as window_end, count(*) as n, count(distinct user_id) as users
from (select user_id, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by 1, 2""",
    "events_sessions": """with o as (select *, case when lag(ts) over (partition by user_id order by ts) + interval '30 minutes' > ts then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select min(ts) as window_start, max(ts) + interval '30 minutes' as window_end, user_id, count(*) as n from s group by user_id, k""",
    "stream_frontier": "select run_id, url_id, case when bool_or(status = 'done') then 'done' else 'queued' end as status from frontier where run_id is not null and url_id is not null group by 1, 2",
    "events_props": "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n, round(sum(value), 2) as total from events group by 1",
}
