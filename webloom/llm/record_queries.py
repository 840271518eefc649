from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.records import newest
from webloom.llm.representatives import judged, prepare, representatives
from webloom.plans.tables import table


def p2_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The record built for each page that several records stand for."""
    rows = table(spark, d, "analysis_rows")
    out = representatives(newest(rows, **prepare(rows)))
    return out.withColumn("sure", F.round("sure", 3))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = p2_representatives(spark, d)
    return out.select("run_id", "group_id", "survivor_id", "title_id", "canonical_id", "n_members")


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each kind of source holds a true value, and how rarely a false one."""
    rows = table(spark, d, "analysis_rows")
    _, quality = judged(newest(rows, **prepare(rows)))
    return spark.createDataFrame([(s, round(a, 4), round(b, 4)) for s, (a, b) in sorted(quality.items())], "source string, sensitivity double, specificity double")


QUERIES = {"p2_found": p2_found, "p2_representatives": p2_representatives, "p2_sources": p2_sources}
_KEY = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z]+://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/index\.(php|html?)$', ''), '/+$', '')
    || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(lower(regexp_extract({0}, '\?([^#]*)', 1)), '&'),
         lambda x: x <> '' and not starts_with(x, 'utm_') and split_part(x, '=', 1) not in ('fbclid', 'gclid', 'msclkid', 'ref_src', 'sessionid'))), 'string_agg', '&'), ''), ''), '^$', '')"""
SQL = {
    "p2_found": f"""
with recursive recs as (
  select run_id, url_id, status, title, canonical_url, url, coalesce(word_count, 0) as words,
         {_KEY.format("url")} as u, case when trim(canonical_url) <> '' then {_KEY.format("canonical_url")} end as c,
         list_filter(list_transform(string_split(lower(main_text), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines
  from (select *, row_number() over (partition by run_id, url_id order by fetched_at desc nulls last, loaded_at desc) as pick from analysis_rows)
  where pick = 1),
named as (
  select run_id, url_id, u as a, true as own, lines from recs
  union all select run_id, url_id, c, false, lines from recs where c <> u),
links as (
  select x.run_id, x.url_id as a, y.url_id as b
  from named x join named y on x.run_id = y.run_id and x.a = y.a and x.url_id <> y.url_id
  where (x.own and y.own) or (len(list_intersect(x.lines, y.lines)) > 0
    and len(list_filter(x.lines, lambda l: not list_contains(y.lines, l))) <= 2 and len(list_filter(y.lines, lambda l: not list_contains(x.lines, l))) <= 2)),
reach as (
  select distinct run_id, a, a as b from links
  union select r.run_id, r.a, l.b from reach r join links l on l.run_id = r.run_id and l.a = r.b),
groups as (select run_id, a as url_id, min(b) as group_id from reach group by 1, 2),
members as (
  select g.group_id, r.*, row_number() over (partition by g.run_id, g.group_id order by coalesce(status = 200, false) desc, words desc, length(url), url, r.url_id) as place
  from groups g join recs r using (run_id, url_id))
select run_id, group_id, arg_min(url_id, place) as survivor_id, coalesce(arg_min(url_id, place) filter (where trim(title) <> ''), -1) as title_id,
       coalesce(arg_min(url_id, place) filter (where trim(canonical_url) <> ''), -1) as canonical_id, count(*) as n_members
from members group by 1, 2""",
}
