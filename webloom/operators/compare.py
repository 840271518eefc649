"""Comparing crawls: by path, page by page over a mapping, and link by link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.text import content_verdict, hamming
from webloom.functions.urls import path_of, redirect_match_key, remapped

FIELDS = ["title", "h1", "meta_description", "word_count"]
TEMPORARY = [302, 303, 307]
MISMATCH = ["redirect_wrong_target", "no_redirect", "error_status", "not_crawled"]


def _key(url: Column, remap: list[tuple[str, str]]) -> Column:
    return F.regexp_replace(path_of(remapped(url, remap)), "^$", "/")


def by_path(pages: DataFrame, remap: list[tuple[str, str]] = (), by: list[str] = ()) -> DataFrame:
    """One row per path of final_url (and of each of ``by``), the last by fetched_at (ties: greatest address)."""
    cols = ["final_url", "requested_url", "sha256", "simhash", *FIELDS, "schema_types"]
    kept = pages.where("final_url is not null").select(*by, _key(F.col("final_url"), remap).alias("path"), F.struct("fetched_at", *cols).alias("row"))
    return kept.groupBy(*by, "path").agg(F.max("row").alias("row")).select(*by, "path", *(f"row.{c}" for c in cols))


def compare_runs(baseline: DataFrame, candidate: DataFrame, remap: list[tuple[str, str]] = (), near: int = 4, by: list[str] = ()) -> DataFrame:
    """One row per path (and of each of ``by``, e.g. session and host) of either side: presence, content verdict, fields that differ, schema types and moves.

    Pages: requested_url, final_url, fetched_at, sha256, simhash, title, h1, meta_description, word_count, schema_types.
    A field is null unless it differs on a path both sides have.  A page whose requested path is not its final one is a
    move and adds a row for the old path.
    """
    keys = [*by, "path"]
    a, b = by_path(baseline, remap, by), by_path(candidate, remap, by)
    left, right = (df.select(*keys, F.lit(True).alias(f"{s}_there"), *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in keys)) for df, s in ((a, "a"), (b, "b")))
    moves = a.where("requested_url <> final_url").select(*by, _key(F.col("requested_url"), remap).alias("from"), F.col("path").alias("to")).where("from <> to").groupBy(*by, "from").agg(F.min("to").alias("to"))
    met = left.join(right, keys, "full_outer").join(moves.select(*by, F.col("from").alias("path"), "to"), keys, "full_outer")
    on_a, on_b = F.coalesce("a_there", F.lit(False)), F.coalesce("b_there", F.lit(False))
    both = on_a & on_b
    distance = F.when(both, hamming(F.col("a_simhash"), F.col("b_simhash"))).cast("int")
    verdict = F.when(both, content_verdict(F.col("a_sha256"), F.col("b_sha256"), distance, near)).otherwise("missing")
    differs = lambda c: both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    fields = [F.when(differs(c), F.col(f"{s}_{c}")).alias(f"{name}_{c}") for c in [*FIELDS, "schema_types"] for s, name in (("a", "baseline"), ("b", "candidate"))]
    return met.select(
        *keys, F.col("a_final_url").alias("baseline_url"), F.col("b_final_url").alias("candidate_url"), on_a.alias("exists_on_baseline"), on_b.alias("exists_on_candidate"), verdict.alias("content_verdict"),
        distance.alias("simhash_distance"), *fields, F.col("to").isNotNull().alias("is_moved_content"), F.col("to").alias("moved_to_path"),
        F.when(F.col("to").isNotNull(), F.concat("path", F.lit(" -> "), "to")).alias("redirect_chain"),
    )


def canonical_changes(baseline: DataFrame, candidate: DataFrame, remap: list[tuple[str, str]] = ()) -> DataFrame:
    """Paths of both sides whose canonicals differ after remapping.  Pages: final_url, fetched_at, canonical_url."""
    one = lambda df, s: df.groupBy(_key(F.col("final_url"), remap).alias("path")).agg(F.max(F.struct("fetched_at", "canonical_url"))["canonical_url"].alias(s))
    met = one(baseline, "baseline_canonical").join(one(candidate, "candidate_canonical"), "path")
    return met.where(~remapped(F.col("baseline_canonical"), remap).eqNullSafe(remapped(F.col("candidate_canonical"), remap)))


def link_changes(baseline: DataFrame, candidate: DataFrame, remap: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, change, href, anchor_text): links of a path that one side lacks.  Links: path, href, anchor_text."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select("path", remapped(F.col("href"), remap).alias("href"), "anchor_text", F.lit(sign).alias("sign")).distinct()

    a, b = side(baseline, -1), side(candidate, 1)
    shared = a.select("path").distinct().join(b.select("path").distinct(), "path", "left_semi")
    net = a.unionByName(b).join(shared, "path", "left_semi").groupBy("path", "href", "anchor_text").agg(F.sum("sign").alias("net")).where("net <> 0")
    return net.select("path", F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"), "href", "anchor_text")


def pair_rows(pairs: DataFrame, pages: DataFrame, near: int = 4) -> DataFrame:
    """Verdicts of a mapping of addresses: how the source redirects and how its content compares with the target's.

    pairs: source_url, target_url; pages: requested_url, final_url, status, hops (array of status), sha256, simhash and
    the compared fields.  A source is found by its requested address, a target also by a final one; of several pages
    the first by requested address counts.
    """
    cols = ["requested_url", "final_url", "status", "hops", "sha256", "simhash", *FIELDS]
    first = lambda df, key: df.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*cols)).alias("p"))
    asked = first(pages, "requested_url")
    ended = first(pages.where("final_url is not null"), "final_url").join(asked.select("key"), "key", "left_anti")
    source = asked.select(F.col("key").alias("source_url"), F.col("p").alias("s"))
    target = asked.unionByName(ended).select(F.col("key").alias("target_url"), F.col("p").alias("t"))
    met = pairs.select("source_url", "target_url").join(source, "source_url", "left").join(target, "target_url", "left")
    key = redirect_match_key
    hops = F.coalesce(F.col("s.hops"), F.array().cast("array<int>"))
    moved = (F.size(hops) > 0) | (key(F.col("s.final_url")) != key(F.col("s.requested_url")))
    same = key(F.col("source_url")) == key(F.col("target_url"))
    verdict = (
        F.when(F.col("s").isNull(), "not_crawled").when((F.col("s.status") == 0) | (F.col("s.status") >= 400), "error_status").when(~moved, F.when(same, "no_redirect_expected").otherwise("no_redirect"))
        .when(key(F.col("s.final_url")) != key(F.col("target_url")), "redirect_wrong_target").when(F.exists(hops, lambda h: h.isin(TEMPORARY)), "redirect_temporary").when(F.size(hops) > 1, "redirect_chain").otherwise("redirect_ok")
    )
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    distance = F.when(both, hamming(F.col("s.simhash"), F.col("t.simhash"))).cast("int")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), c) for c in FIELDS)))
    return met.select(
        "source_url", "target_url", F.col("s.status").alias("source_status"), F.col("t.status").alias("target_status"), F.col("s.final_url").alias("source_final_url"), verdict.alias("redirect_verdict"),
        F.size(hops).alias("n_hops"), F.when(both, F.col("s.sha256").eqNullSafe(F.col("t.sha256"))).alias("sha256_equal"), distance.alias("simhash_distance"),
        F.when(both, content_verdict(F.col("s.sha256"), F.col("t.sha256"), distance, near)).otherwise("missing").alias("content_verdict"), F.array_join(changed, ",").alias("changed_fields"),
    )


def failing(rows: DataFrame, mode: str) -> DataFrame:
    """Rows a gate stops at: redirect_mismatch, content_changed or any."""
    redirect, content = F.col("redirect_verdict").isin(MISMATCH), F.col("content_verdict") == "changed"
    tests = {"redirect_mismatch": redirect, "content_changed": content, "any": redirect | content}
    if mode not in tests:
        raise ValueError(f"unknown gate {mode!r}")
    return rows.where(tests[mode])


def first_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped with reason) of a mapping: line, source_url, target_url, note; the first line of a source counts."""
    t = rows.select("line", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("source_url", "target_url", "note")))
    good = (F.col("source_url") != "") & (F.col("target_url") != "")
    seen = t.where(good).withColumn("rank", F.row_number().over(Window.partitionBy("source_url").orderBy("line")))
    blank = t.where(~good).withColumn("reason", F.when(F.col("source_url") == "", "empty source").otherwise(F.concat(F.lit("empty target for "), "source_url")))
    twice = seen.where("rank > 1").withColumn("reason", F.concat(F.lit("duplicate source "), "source_url"))
    pairs = seen.where("rank = 1").select("source_url", "target_url", F.when(F.col("note") != "", F.col("note")).alias("note"))
    return pairs, blank.select("line", "reason").unionByName(twice.select("line", "reason"))


def compare_renders(a: DataFrame, b: DataFrame) -> DataFrame:
    """Verdict per url of two renderings (url, title, description, canonical, size, links): a without scripts, b with."""
    norm = lambda c: F.lower(F.trim(c))
    left, right = (df.select("url", *(F.col(c).alias(f"{s}_{c}") for c in ("title", "description", "canonical", "size", "links"))) for df, s in ((a, "a"), (b, "b")))
    met = left.join(right, "url")
    drift = ~(norm("a_title").eqNullSafe(norm("b_title")) & norm("a_description").eqNullSafe(norm("b_description")) & norm("a_canonical").eqNullSafe(norm("b_canonical")))
    new = F.array_except("b_links", "a_links")
    sections = F.size(F.array_distinct(F.transform(new, lambda u: F.get(F.filter(F.split(path_of(u), "/"), lambda x: x != ""), F.lit(0)))))
    delta = F.when(F.col("a_size") > 0, (F.col("b_size") - F.col("a_size")) / F.col("a_size") * 100).otherwise(0.0)
    verdict = F.when(drift, "meta_drift").when((F.size(new) > 5) & (sections <= 3), "nav_js_injected").when(F.abs(delta) > 30, "content_js_only").otherwise("ok")
    return met.select("url", verdict.alias("verdict"), F.size(new).alias("n_only_b"), F.size(F.array_except("a_links", "b_links")).alias("n_only_a"), F.round(delta, 2).alias("size_delta"))
