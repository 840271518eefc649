"""Similarity, overlap, comparison and reports over the crawl tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.urls import plain_host, plain_path
from webloom.operators import compare, overlap, reports, similarity, views
from webloom.plans import url_queries as u
from webloom.plans.tables import table
from webloom.scratch import Scratch

LEAST = 0.30  # the largest cosine of the embeddings table is 0.51


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.lit("all").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def sim_pairs(spark, d):
    return similarity.cosine_pairs(_vectors(spark, d), LEAST).select("a", "b", F.round("sim", 4).alias("sim"))


def sim_pairs_by_label(spark, d):
    """Similar pairs of different labels: those of one label are suppressed."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    pairs = similarity.cosine_pairs(_vectors(spark, d), LEAST)
    a, b = (labels.select(F.col("vec_id").alias(s), F.col("label").alias(f"label_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").where("label_a <> label_b").select("a", "b", F.round("sim", 4).alias("sim"))


def sim_nearest(spark, d):
    return similarity.nearest_sims(_vectors(spark, d)).select("id", F.round("nn", 6).alias("nn"))


def _page_vectors(spark, d):
    recs = u.records(spark, d, "embedding", "embedding_model")
    return recs.select(F.coalesce("embedding_model", F.lit("")).alias("part"), F.col("url_id").alias("id"), F.col("embedding").alias("vector"))


def sim_ann_pairs(spark, d):
    """Pages whose vectors of one model have a cosine of 0.9 or more, by the inverted file."""
    return similarity.ann_pairs(_page_vectors(spark, d), 0.9).select("part", "a", "b", F.round("sim", 4).alias("sim"))


def sim_ann_recall(spark, d):
    """Recall of the inverted file against the exact join, and which share of all pairs it looks at."""
    counts = similarity.recall_by_lists(_page_vectors(spark, d), 0.9)
    return counts.select(F.round("recall", 4).alias("recall"), F.round(F.col("looked") / F.col("every"), 4).alias("looked_at"))


def sim_distribution(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("pages"))
    return similarity.distribution(similarity.nearest_sims(rows), similarity.cosine_pairs(rows, similarity.GRID_LOW), sizes)


def sim_percentile_rank(spark, d):
    v = _vectors(spark, d)
    pairs = similarity.cosine_pairs(v, LEAST).select("a", "b", F.round("sim", 4).alias("sim"))
    return similarity.percentile_ranks(pairs, "sim", similarity.nearest_sims(v))


def clusters_single(spark, d):
    return similarity.single_linkage(similarity.cosine_pairs(_vectors(spark, d), 0.40)).select("id", "cluster")


def clusters_complete(spark, d):
    v = _vectors(spark, d)
    return similarity.complete_linkage(similarity.cosine_pairs(v, 0.36), v, 0.36).select("id", "cluster")


def cluster_cohesion(spark, d):
    v = _vectors(spark, d)
    members = Scratch(spark).cut(similarity.single_linkage(similarity.cosine_pairs(v, 0.40)), "members")
    out = similarity.cluster_cohesion(members, v)
    return out.select("cluster", "size", *(F.round(c, 4).alias(c) for c in ("min_sim", "mean_sim", "cohesion")))


def off_topic(spark, d):
    """Vectors in the lowest twentieth of similarity to the centroid."""
    sims = similarity.centroid_sims(_vectors(spark, d))
    cut = sims.agg(F.percentile("sim", F.lit(0.05)).alias("cut"))  # one row
    return sims.crossJoin(F.broadcast(cut)).where("sim <= cut").select("id", F.round("sim", 6).alias("sim"))


def projection(spark, d):
    return similarity.projection(_vectors(spark, d)).select("id", "x", "y")


def _prepared(spark, d):
    recs = u.records(spark, d, "url", "embedding", "embedding_model", "hreflang_group", "hreflang_code", "word_count", "signal_confidence", "signature_model_input", "status", "kind")
    recs = recs.where("status = 200 and kind = 'html' and url is not null")
    return overlap.prepared(recs.withColumnRenamed("embedding", "vector"))


SECTIONS = ["/news", "/blog"]


def _overlap(spark, d):
    """Pages and pairs, each computed once."""
    scratch = Scratch(spark)
    pages = scratch.cut(_prepared(spark, d), "pages")
    return pages, scratch.cut(overlap.overlap_pairs(pages, sections=SECTIONS), "pairs")


def overlap_pairs(spark, d):
    return overlap.overlap_pairs(_prepared(spark, d), sections=SECTIONS).withColumn("sim", F.round("sim", 4))


def overlap_page_risks(spark, d):
    return overlap.page_risks(*_overlap(spark, d)).where("risk <> ''").select("part", "id", "max_similarity", "risk")


def overlap_clusters(spark, d):
    pages, pairs = _overlap(spark, d)
    out = overlap.cluster_rows(pages, pairs, overlap.clusters(pages, pairs), sections=SECTIONS)
    return out.select("part", "cluster", "size", "suggested_canonical", "relation", "languages", "avg_word_count", "thin", "min_intra_sim", "chained")


def overlap_summary(spark, d):
    return overlap.page_risks(*_overlap(spark, d)).groupBy("risk").agg(F.count("*").alias("n"))


def _sessions(spark, d):
    """(baseline, candidate, session_id) of each two consecutive snapshots; one row a snapshot."""
    runs = table(spark, d, "page_run_snapshots").select("run_id").distinct()
    after = runs.select(F.col("run_id").alias("baseline"), F.lead("run_id").over(Window.orderBy("run_id")).alias("candidate")).where("candidate is not null")
    return after.withColumn("session_id", F.concat(F.lit("cmp-"), F.regexp_replace("baseline", "^snap-", ""), F.lit("-"), F.regexp_replace("candidate", "^snap-", "")))


def _snapshots(spark, d, side):
    """Pages of all snapshots with the session in which theirs is the ``side``."""
    rows = table(spark, d, "page_run_snapshots").join(F.broadcast(_sessions(spark, d)), F.col("run_id") == F.col(side))
    path, host = plain_path(F.col("url")), plain_host(F.col("url"))
    plain = F.concat(F.lit("https://"), host, path)
    return rows.select("session_id", host.alias("host"), plain.alias("requested_url"), plain.alias("final_url"), "fetched_at", F.col("content_hash_sha256").alias("sha256"), F.col("content_hash_simhash").alias("simhash"), "title", F.split_part("h1_tags", F.lit("\n"), F.lit(1)).alias("h1"), "meta_description", "word_count", F.lit(None).cast("array<string>").alias("schema_types"))


def compare_runs(spark, d):
    """Each two consecutive snapshots, page by page."""
    out = compare.compare_runs(_snapshots(spark, d, "baseline"), _snapshots(spark, d, "candidate"), by=["session_id", "host"])
    return out.select("session_id", "host", "path", "exists_on_baseline", "exists_on_candidate", "content_verdict", "simhash_distance", "baseline_title", "candidate_title", "baseline_h1", "candidate_h1", "baseline_word_count", "candidate_word_count", "is_moved_content")


def view_url_moves(spark, d):
    return table(spark, d, "compare_rows").where("is_moved_content").select("session_id", "path", "baseline_url", "candidate_url").distinct()


def view_content_differences(spark, d):
    differs = F.lit(False)
    for c in ("title", "h1", "word_count"):
        differs = differs | ~F.col(f"baseline_{c}").eqNullSafe(F.col(f"candidate_{c}"))
    rows = table(spark, d, "compare_rows").where("exists_on_baseline and exists_on_candidate").where(differs)
    return rows.select("session_id", "host", "path", "baseline_title", "candidate_title", "baseline_h1", "candidate_h1", "baseline_word_count", "candidate_word_count")


def view_schema_comparison(spark, d):
    rows = table(spark, d, "compare_rows").where("exists_on_baseline and exists_on_candidate").where(~F.col("baseline_schema_types").eqNullSafe(F.col("candidate_schema_types")))
    return rows.select("session_id", "host", "path", F.array_join("baseline_schema_types", ",").alias("baseline_types"), F.array_join("candidate_schema_types", ",").alias("candidate_types"))


def _pages(spark, d):
    return table(spark, d, "page_run_snapshots").select("run_id", "url_id", "url", "kind", "final_url", "initial_status_code", "final_status_code", "fetched_at", "title", "meta_description", "h1_tags", "overall_indexable").distinct()


def report_overview(spark, d):
    return reports.overview(_pages(spark, d))


def report_hubs(spark, d):
    return reports.hub_pages(table(spark, d, "frontier"), 20)


def report_orphans(spark, d):
    pages = table(spark, d, "frontier").select("run_id", "url_id", F.concat(F.lit("https://h/"), "url_id").alias("url"), F.lit("html").alias("kind"))
    return reports.orphan_pages(pages, table(spark, d, "frontier"))


def report_redirects(spark, d):
    rows = table(spark, d, "identity_pages").select("run_id", "url", "final_url", F.col("status").alias("initial_status_code"), F.col("status").alias("final_status_code")).distinct()
    return reports.redirects(rows)


def report_sitemap(spark, d):
    pages = u.records(spark, d, "url", "kind", "status", "overall_indexable", "canonical_url")
    own = F.when(F.col("canonical_url").isNotNull(), F.array("canonical_url")).otherwise(F.array().cast("array<string>"))
    return reports.sitemap_pages(pages.withColumn("final_status_code", F.col("status")).withColumn("canonical_urls", own))


def report_indexability(spark, d):
    return _pages(spark, d).select("run_id", "final_status_code", "overall_indexable").groupBy("run_id", "final_status_code", "overall_indexable").agg(F.count("*").alias("n"))


def report_frontier(spark, d):
    return reports.frontier_counts(table(spark, d, "frontier"))


def report_next_batch(spark, d):
    entries = table(spark, d, "frontier").select("run_id", "url_id", "status", "retry_at", "priority_score", "enqueued_at").distinct()
    return reports.next_batch(entries, 1_740_000_000, 100).select("run_id", "url_id", "priority_score", "enqueued_at")


def report_stale(spark, d):
    pages = _pages(spark, d)
    return reports.stale(pages, pages, 1_748_600_000, 14)


def report_archive_missing(spark, d):
    """Addresses of the first snapshot that the last one lacks."""
    pages = _pages(spark, d)
    return reports.archive_gaps(pages.where("run_id = 'snap-w01'"), pages.where("run_id = 'snap-w08'"))[0]


def report_link_counts(spark, d):
    links = u.records(spark, d, "url", "canonical_url").select("run_id", F.col("url").alias("source"), F.col("canonical_url").alias("target"))
    return reports.link_counts(links)


def page_tabs(spark, d):
    """How many pages of a run belong to each tab."""
    pages = _pages(spark, d).withColumn("canonical_urls", F.array("url"))
    return pages.select("run_id", F.explode(views.tabs()).alias("tab")).groupBy("run_id", "tab").agg(F.count("*").alias("n"))


def site_structure(spark, d):
    return views.site_structure(_pages(spark, d), 50)


QUERIES = {
    f.__name__: f
    for f in (
        sim_pairs, sim_pairs_by_label, sim_nearest, sim_ann_pairs, sim_ann_recall, sim_distribution, sim_percentile_rank, clusters_single, clusters_complete, cluster_cohesion, off_topic, projection, overlap_pairs, overlap_page_risks, overlap_clusters,
        overlap_summary, compare_runs, view_url_moves, view_content_differences, view_schema_comparison, report_overview, report_hubs, report_orphans, report_redirects, report_sitemap, report_indexability, report_frontier,
        report_next_batch, report_stale, report_archive_missing, report_link_counts, page_tabs, site_structure,
    )
}

# --- the same in SQL ------------------------------------------------------------------------

_V = "v as (select vec_id as id, embedding::double[] as e, label from embeddings)"


def _p(least, more=""):
    return f"p as (select x.id as a, y.id as b, list_cosine_similarity(x.e, y.e) as s from v x join v y on x.id < y.id where list_cosine_similarity(x.e, y.e) >= {least} {more})"


_NN = "nn as (select x.id, max(list_cosine_similarity(x.e, y.e)) as nn from v x join v y on x.id <> y.id group by 1)"
_REACH = """reach as (select a, a as b from (select a from p union select b from p) union select r.a, case when r.b = p.a then p.b else p.a end from reach r join p on r.b in (p.a, p.b)),
comp as (select a as id, min(b) as cluster from reach group by 1)"""
_GRID = ", ".join(f"count(*) filter (where s >= {0.80 + k / 100:.2f}) as \"pairs_at_{0.80 + k / 100:.2f}\"" for k in range(16))
_GRID0 = ", ".join(f"coalesce(\"pairs_at_{0.80 + k / 100:.2f}\", 0) as \"pairs_at_{0.80 + k / 100:.2f}\"" for k in range(16))
_WORDS = u._WORDS.format("signature_model_input")
_NPATH = u._npath
_OVER = f"""{u._RECS},
pg as (
  select run_id || '/' || case when hreflang_code <> '' then lower(split_part(hreflang_code, '-', 1)) else 'unknown' end || '/' || coalesce(embedding_model, '') as part, url_id as id, url, embedding::double[] as e, hreflang_group as g, hreflang_code as code, coalesce(word_count, 0) as words,
    coalesce(signal_confidence = 'low', false) as low, signature_model_input is not null and ({_WORDS}) < 88 as thin, {u._segments('url')} as seg, {u._netloc('url')} as host, {_NPATH('url')} as np
  from recs where status = 200 and kind = 'html' and url is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pr as (
  select x.part, x.id as a, y.id as b, list_cosine_similarity(x.e, y.e) as s, x.url as url_a, y.url as url_b, x.low or y.low as low_confidence,
    case when x.host <> y.host then 'cross-section' when x.seg = y.seg then 'sibling'
      when len(x.seg) = 0 or len(y.seg) = 0 or (len(x.seg) <> len(y.seg) and x.seg[1:least(len(x.seg), len(y.seg))] = y.seg[1:least(len(x.seg), len(y.seg))]) then 'parent-child'
      when len(x.seg) = len(y.seg) and len(x.seg) >= 2 and x.seg[1:len(x.seg) - 1] = y.seg[1:len(y.seg) - 1] then 'sibling' when x.seg[1] = y.seg[1] then 'same-section' else 'cross-section' end as relation,
    coalesce(x.seg[1], '/') as section_a, coalesce(y.seg[1], '/') as section_b, case when x.thin and y.thin then 'both' when x.thin or y.thin then 'asymmetric' else '' end as thin,
    case when {" or ".join(f"((x.np = '{s}' or starts_with(x.np, '{s}/')) and (y.np = '{s}' or starts_with(y.np, '{s}/')))" for s in SECTIONS)} then 'time-sequenced' else '' end as pair_class
  from pg x join pg y on x.part = y.part and x.id < y.id where len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.85 and not coalesce(x.g = y.g, false)),
ed as (select part, a as id, b as other, s, relation, thin, pair_class from pr union all select part, b, a, s, relation, thin, pair_class from pr),
fl as (
  select part, id, max(s) as m, bool_or(s >= 0.92) as dup, bool_or(s >= 0.92 and thin <> 'both') as rich, bool_or(s >= 0.92 and pair_class = '') as plain_dup,
    bool_and(relation = 'parent-child') filter (where s >= 0.92 and pair_class = '') as hub, bool_or(pair_class = '') as plain, bool_or(pair_class <> '') as timed from ed group by 1, 2),
ri as (
  select p.part, p.id, round(coalesce(m, 0), 4) as max_similarity, case when dup and not rich then '{overlap.THIN}' when plain_dup then case when hub then '{overlap.PARENT_CHILD}' else '{overlap.DUPLICATE}' end
    when plain then '{overlap.HIGH}' when timed then '{overlap.SEQUENCED}' else '' end as risk from pg p left join fl using (part, id))"""
_SNAP = r"""(select s.session_id, p.*, split_part(h1_tags, chr(10), 1) as h1,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/index\.(php|html?)$', ''), '/+$', ''), '^$', '/') as path,
    regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '//([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '') as host
  from page_run_snapshots p join sessions s on p.run_id = s.{0} qualify row_number() over (partition by s.session_id, host, path order by fetched_at desc nulls last, content_hash_sha256 desc nulls last, content_hash_simhash desc nulls last, title desc nulls last) = 1)"""
_SESSIONS = """sessions as (select *, 'cmp-' || replace(baseline, 'snap-', '') || '-' || replace(candidate, 'snap-', '') as session_id from (
  select run_id as baseline, lead(run_id) over (order by run_id) as candidate from (select distinct run_id from page_run_snapshots)) where candidate is not null)"""
_CMP = "case when a.path is null or b.path is null then null else {0} end"
_DIFF = lambda c: (f"case when a.path is not null and b.path is not null and a.{c} is distinct from b.{c} then a.{c} end", f"case when a.path is not null and b.path is not null and a.{c} is distinct from b.{c} then b.{c} end")
_DIST = "bit_count(xor(a.content_hash_simhash, b.content_hash_simhash))"
_PAGES = "pg as (select distinct run_id, url_id, url, kind, final_url, initial_status_code, final_status_code, fetched_at, title, meta_description, h1_tags, overall_indexable from page_run_snapshots)"
_LABELS = {
    "total": "true", "indexable": "overall_indexable", "https": "starts_with(url, 'https://')", "c2xx": "final_status_code between 200 and 299", "c3xx": "final_status_code between 300 and 399", "c4xx": "final_status_code between 400 and 499",
    "c5xx": "final_status_code >= 500", "html": "kind = 'html'", "missing_title": "kind = 'html' and coalesce(trim(title), '') = ''", "missing_meta": "kind = 'html' and coalesce(trim(meta_description), '') = ''", "missing_h1": "kind = 'html' and coalesce(trim(h1_tags), '') = ''",
}

_TABS = {
    "response-codes": "not coalesce(final_status_code between 200 and 299, false)", "titles": "coalesce(trim(title), '') = ''", "descriptions": "coalesce(trim(meta_description), '') = ''", "headings": "coalesce(trim(h1_tags), '') = ''",
    "directives": "not coalesce(overall_indexable, true)", "security": "not starts_with(url, 'https://')",
}

SQL = {
    "page_tabs": f"with {_PAGES}\n" + "\nunion all ".join(f"select run_id, '{k}' as tab, count(*) as n from pg where {t} group by 1" for k, t in _TABS.items()),
    "site_structure": f"with {_PAGES} select {u._netloc('url')} as host, coalesce(({u._segments('url')})[1], '/') as section, count(*) as pages from pg group by 1, 2 order by pages desc, host, section limit 50",
    "sim_pairs": f"with {_V}, {_p(LEAST)} select a, b, round(s, 4) as sim from p",
    "sim_pairs_by_label": f"with {_V}, {_p(LEAST, 'and x.label <> y.label')} select a, b, round(s, 4) as sim from p",
    "sim_ann_pairs": f"""with {u._RECS}, v as (select coalesce(embedding_model, '') as part, url_id as id, embedding::double[] as e from recs where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
select x.part, x.id as a, y.id as b, round(list_cosine_similarity(x.e, y.e), 4) as sim from v x join v y on x.part = y.part and len(x.e) = len(y.e) and x.id < y.id where list_cosine_similarity(x.e, y.e) >= 0.9""",
    "sim_nearest": f"with {_V}, {_NN} select id, round(nn, 6) as nn from nn",
    "sim_distribution": f"""with {_V}, n as (select x.label, x.id, max(list_cosine_similarity(x.e, y.e)) as nn from v x join v y on x.label = y.label and x.id <> y.id group by 1, 2),
q as (select label, quantile_cont(nn, [0.5, 0.9, 0.95, 0.99, 0.999]) as p from n group by 1), g as (select label, {_GRID} from (select x.label, list_cosine_similarity(x.e, y.e) as s from v x join v y on x.label = y.label and x.id < y.id) group by 1)
select cast(label as varchar) as part, count(*) as pages, round(any_value(p[1]), 4) as p50, round(any_value(p[2]), 4) as p90, round(any_value(p[3]), 4) as p95, round(any_value(p[4]), 4) as p99, round(any_value(p[5]), 4) as p99_9,
  {", ".join(f'coalesce(any_value("pairs_at_{0.80 + k / 100:.2f}"), 0) as "pairs_at_{0.80 + k / 100:.2f}"' for k in range(16))} from v left join q using (label) left join g using (label) group by label""",
    "sim_percentile_rank": f"""with {_V}, {_NN}, {_p(LEAST)}, r as (select a, b, round(s, 4) as sim from p)
select a, b, sim, round(100.0 * (select count(*) from nn where ceil(round(nn.nn * 10000, 6)) <= round(r.sim * 10000, 6)) / (select count(*) from nn), 2) as percentile from r""",
    "clusters_single": f"with recursive {_V}, {_p(0.40)}, {_REACH} select id, cluster from comp",
    "cluster_cohesion": f"""with recursive {_V}, {_p(0.40)}, {_REACH},
m as (select c.cluster, v.id, v.e from comp c join v using (id)), s as (select x.cluster, min(list_cosine_similarity(x.e, y.e)) as lo, avg(list_cosine_similarity(x.e, y.e)) as av from m x join m y on x.cluster = y.cluster and x.id < y.id group by 1)
select cluster, (select count(*) from m where m.cluster = s.cluster) as size, round(lo, 4) as min_sim, round(av, 4) as mean_sim, round(lo / av, 4) as cohesion from s""",
    "off_topic": f"""with {_V}, u as (select id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
c as (select list(x order by d) as c from (select d, avg(x) as x from (select unnest(e) as x, generate_subscripts(e, 1) as d from u) group by d)),
s as (select id, list_dot_product(e, c) / sqrt(list_dot_product(c, c)) as sim from u, c)
select id, round(sim, 6) as sim from s where sim <= (select quantile_cont(sim, 0.05) from s)""",
    "overlap_pairs": f"with {_OVER} select part, a, b, round(s, 4) as sim, url_a, url_b, low_confidence, relation, section_a, section_b, thin, pair_class from pr",
    "overlap_page_risks": f"with {_OVER} select part, id, max_similarity, risk from ri where risk <> ''",
    "overlap_summary": f"with {_OVER} select risk, count(*) as n from ri group by 1",
    "compare_runs": f"""with {_SESSIONS}, a as {_SNAP.format('baseline')}, b as {_SNAP.format('candidate')}
select coalesce(a.session_id, b.session_id) as session_id, coalesce(a.host, b.host) as host, coalesce(a.path, b.path) as path, a.path is not null as exists_on_baseline, b.path is not null as exists_on_candidate,
  case when a.path is null or b.path is null then 'missing' when (a.content_hash_sha256 is null or b.content_hash_sha256 is null) and {_DIST} is null then 'unknown' when a.content_hash_sha256 = b.content_hash_sha256 then 'identical' when {_DIST} <= 4 then 'near' else 'changed' end as content_verdict,
  cast({_CMP.format(_DIST)} as int) as simhash_distance, {_DIFF('title')[0]} as baseline_title, {_DIFF('title')[1]} as candidate_title, {_DIFF('h1')[0]} as baseline_h1, {_DIFF('h1')[1]} as candidate_h1,
  {_DIFF('word_count')[0]} as baseline_word_count, {_DIFF('word_count')[1]} as candidate_word_count, false as is_moved_content
from a full outer join b on a.session_id = b.session_id and a.host = b.host and a.path = b.path""",
    "view_url_moves": "select distinct session_id, path, baseline_url, candidate_url from compare_rows where is_moved_content",
    "view_content_differences": """select session_id, host, path, baseline_title, candidate_title, baseline_h1, candidate_h1, baseline_word_count, candidate_word_count from compare_rows
where exists_on_baseline and exists_on_candidate and (baseline_title is distinct from candidate_title or baseline_h1 is distinct from candidate_h1 or baseline_word_count is distinct from candidate_word_count)""",
    "view_schema_comparison": """select session_id, host, path, array_to_string(baseline_schema_types, ',') as baseline_types, array_to_string(candidate_schema_types, ',') as candidate_types from compare_rows
where exists_on_baseline and exists_on_candidate and baseline_schema_types is distinct from candidate_schema_types""",
    "report_overview": f"with {_PAGES}, t as (select run_id, count(*) as total, " + ", ".join(f"count(*) filter (where {t}) as {k}" for k, t in _LABELS.items() if k != "total") + " from pg group by 1)\n" + "\nunion all ".join(f"select run_id, '{k}' as label, {k} as n, round({k} * 100.0 / total, 1)::double as pct from t" for k in _LABELS),
    "report_hubs": "select run_id, parent_id, count(*) as outlinks from frontier where parent_id is not null group by 1, 2 having count(*) >= 20",
    "report_orphans": "select distinct run_id, url_id, 'https://h/' || url_id as url from frontier f where not exists (select 1 from frontier g where g.run_id = f.run_id and g.url_id = f.url_id and g.parent_id is not null)",
    "report_redirects": "select distinct run_id, url as requested_url, final_url, status as initial_status_code, status as final_status_code from identity_pages where url <> final_url",
    "report_sitemap": f"with {u._RECS} select distinct run_id, url from recs where kind = 'html' and status = 200 and coalesce(overall_indexable, true) and coalesce(canonical_url = url, true)",
    "report_indexability": f"with {_PAGES} select run_id, final_status_code, overall_indexable, count(*) as n from pg group by 1, 2, 3",
    "report_frontier": "select run_id, status, count(*) as n from frontier group by 1, 2",
    "report_next_batch": """with e as (select distinct run_id, url_id, status, retry_at, priority_score, enqueued_at from frontier)
select run_id, url_id, priority_score, enqueued_at from e where status = 'queued' and coalesce(retry_at, 0) <= 1740000000 order by priority_score desc nulls last, enqueued_at, run_id, url_id limit 100""",
    "report_stale": "select distinct url from page_run_snapshots p where not exists (select 1 from page_run_snapshots q where q.url = p.url and q.final_status_code = 200 and q.fetched_at >= 1748600000 - 14 * 86400)",
    "report_archive_missing": "select distinct url from page_run_snapshots p where run_id = 'snap-w01' and url is not null and not exists (select 1 from page_run_snapshots q where q.run_id = 'snap-w08' and q.url = p.url)",
    "report_link_counts": f"""with {u._RECS}, e as (select distinct run_id, url as s, canonical_url as t from recs where url is not null and canonical_url is not null),
o as (select run_id, s as url, count(*) as outlinks, count(*) filter (where {u._netloc('s')} <> {u._netloc('t')}) as external from e group by 1, 2), i as (select run_id, t as url, count(*) as inlinks from e group by 1, 2)
select run_id, url, coalesce(inlinks, 0) as inlinks, coalesce(outlinks, 0) as outlinks, coalesce(external, 0) as external from o full outer join i using (run_id, url)""",
}
