"""Queries of the general corpus problems: hierarchies and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.hierarchy import descendants, hierarchy, latest_links
from webloom.operators.snapshots import snapshot_changes
from webloom.plans.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return latest_links(table(spark, d, "frontier"), "run_id", "url_id", "parent_id", "updated_at", "id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy(_links(spark, d))
    return out.select(F.col("tree").alias("run_id"), F.col("node").alias("url_id"), F.col("root").alias("root_id"), F.col("hops").cast("long").alias("hops"), "n_below")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of every entry that has one."""
    out = hierarchy(_links(spark, d), with_path=True).where("hops >= 0")
    return out.select(F.col("tree").alias("run_id"), F.col("node").alias("url_id"), F.col("hops").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every entry below each ancestor, and how many links below."""
    out = descendants(hierarchy(_links(spark, d), with_path=True).where("hops > 0"))
    return out.select(F.col("tree").alias("run_id"), "ancestor", F.col("node").alias("url_id"), F.col("distance").cast("long").alias("distance"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "page_run_snapshots"))


QUERIES = {"p1_found": p1_found, "p1_descendants": p1_descendants, "p1_paths": p1_paths, "p4_found": p4_found}

_NEWEST = """
newest as (
  select run_id, url_id, parent_id from (
    select *, row_number() over (partition by run_id, url_id order by updated_at desc nulls last, id desc) as pick
    from frontier where run_id is not null and url_id is not null)
  where pick = 1),
links as (
  select n.run_id, n.url_id, p.url_id as parent
  from newest n left join newest p on p.run_id = n.run_id and p.url_id = n.parent_id)"""

SQL = {
    "p1_found": f"""
with recursive {_NEWEST.strip()},
pairs as (
  select run_id, url_id, parent as up from links where parent is not null
  union
  select p.run_id, p.url_id, l.parent from pairs p join links l on l.run_id = p.run_id and l.url_id = p.up where l.parent is not null),
loops as (select distinct run_id, url_id from pairs where url_id = up),
above as (
  select p.run_id, p.url_id, count(*) as n, min(case when c.url_id is not null then p.up end) as loop_id,
         min(case when l.parent is null then p.up end) as top_id
  from pairs p join links l on l.run_id = p.run_id and l.url_id = p.up
       left join loops c on c.run_id = p.run_id and c.url_id = p.up
  group by 1, 2),
below as (select run_id, up as url_id, count(*) as n from pairs where up <> url_id group by 1, 2)
select l.run_id, l.url_id, coalesce(a.loop_id, a.top_id, l.url_id) as root_id,
       cast(case when c.url_id is not null then -1 when a.loop_id is not null then -2 else coalesce(a.n, 0) end as bigint) as hops,
       cast(coalesce(b.n, 0) as bigint) as n_below
from links l left join above a using (run_id, url_id) left join below b using (run_id, url_id) left join loops c using (run_id, url_id)""",
    "p1_paths": f"""
with recursive {_NEWEST.strip()},
walk as (
  select run_id, url_id, 0 as depth, cast(url_id as varchar) as path from links where parent is null
  union all
  select l.run_id, l.url_id, w.depth + 1, w.path || '/' || l.url_id from walk w join links l on l.run_id = w.run_id and l.parent = w.url_id)
select run_id, url_id, cast(depth as bigint) as depth, path from walk""",
    "p1_descendants": f"""
with recursive {_NEWEST.strip()},
rooted as (
  select run_id, url_id from links where parent is null
  union all select l.run_id, l.url_id from rooted r join links l on l.run_id = r.run_id and l.parent = r.url_id),
below as (
  select run_id, parent as ancestor, url_id, 1 as distance from links join rooted using (run_id, url_id) where parent is not null
  union all
  select b.run_id, l.parent, b.url_id, b.distance + 1 from below b join links l on l.run_id = b.run_id and l.url_id = b.ancestor where l.parent is not null)
select run_id, ancestor, url_id, cast(distance as bigint) as distance from below""",
    "p4_found": r"""
with rows_ as (
  select run_id, fetched_at, title,
         regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':\d*$', ''), '^www\.', '') as host,
         regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/index\.(php|html?)$', ''), '/+$', '') as path
  from page_run_snapshots where run_id is not null and trim(url) <> ''),
state as (
  select run_id, host, path, nullif(trim(regexp_replace(nfc_normalize(replace(regexp_replace(replace(title, chr(160), ' '), '[\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '&amp;', '&')), '\s+', ' ', 'g')), '') as title
  from (select *, row_number() over (partition by run_id, host, path order by fetched_at desc nulls last, title desc nulls last) as pick from rows_)
  where pick = 1),
pairs as (
  select run_id as a, lead(run_id) over (order by run_id) as b from (select distinct run_id from state)),
sides as (
  select 'cmp-' || replace(a, 'snap-', '') || '-' || replace(b, 'snap-', '') as session_id, a, b from pairs where b is not null),
both_ as (
  select session_id, host, path, max(case when run_id = a then 1 else 0 end) as before_, max(case when run_id = b then 1 else 0 end) as after_,
         max(case when run_id = a then title end) as t, max(case when run_id = b then title end) as u
  from sides join state on run_id in (a, b) group by 1, 2, 3)
select session_id, host, path, case when before_ = 0 then 'added' when after_ = 0 then 'removed' else 'changed' end as change_kind
from both_ where before_ + after_ = 1 or t <> u""",
}
