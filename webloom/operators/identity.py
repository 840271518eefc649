"""Who is who among addresses: language groups, variants, AMP twins, exclusions and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import amp_base_url, base_url, lang_bucket, normalise_url, page_match_key, query_of, query_without_tracking
from webloom.operators.components import connected_components
from webloom.operators.ranks import numbered


def hreflang_groups(edges: DataFrame) -> DataFrame:
    """(norm_url, hreflang_group, declared) of normalised addresses linked as language alternates.

    edges: url, alt_url, code.  Groups of two or more are named H0000, H0001, … by their first member; declared is
    the smallest code but x-default that points at the address.  Edges with a null or blank end are ignored.
    """
    e = edges.where("url <> '' and alt_url <> ''").select(normalise_url(F.col("url")).alias("a"), normalise_url(F.col("alt_url")).alias("b"), "code")
    members = connected_components(e.select("a", "b"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    named = numbered(sizes.select("component"), "component", "k").select("component", F.format_string("H%04d", "k").alias("hreflang_group"))
    declared = e.where("code <> '' and code <> 'x-default'").groupBy(F.col("b").alias("node")).agg(F.min("code").alias("declared"))
    out = members.join(named, "component").join(declared, "node", "left")
    return out.select(F.col("node").alias("norm_url"), "hreflang_group", "declared")


def reciprocity_issues(edges: DataFrame) -> DataFrame:
    """Alternates without a link back: url, declares_alternate, hreflang, issue."""
    e = edges.where("url is not null and alt_url is not null").select("*", normalise_url(F.col("url")).alias("a"), normalise_url(F.col("alt_url")).alias("b"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    lone = e.where("a <> b").join(back, ["a", "b"], "left_anti")
    return lone.select("url", F.col("alt_url").alias("declares_alternate"), F.coalesce("code", F.lit("")).alias("hreflang"), F.lit("no return link from alternate").alias("issue"))


def resolved_language(declared: Column, html_lang: Column) -> Column:
    """Declared code, else the page's own in lower case; null if there is neither."""
    own = F.lower(F.trim(html_lang))
    return F.coalesce(F.when(declared != "", declared), F.when(own != "", own))


def variants(pages: DataFrame, within: list[str]) -> DataFrame:
    """Every page of a shared normalised address with its representative and rank.

    pages: url, norm_url, status, redirected, word_count and the columns ``within``.  Best is not redirected, status
    200, more words, shorter, smaller address.
    """
    best = F.struct(F.coalesce("redirected", F.lit(False)).cast("int"), F.when(F.col("status") == 200, 0).otherwise(1), -F.coalesce("word_count", F.lit(0)), F.length("url"), "url")
    groups = pages.withColumn("best", best).groupBy(*within, "norm_url").agg(F.count("*").alias("n"), F.min("best").alias("best")).where("n > 1")
    rep = groups.select(*within, "norm_url", F.col("best.url").alias("representative"), F.col("n").alias("n_members"))
    return pages.join(rep, [*within, "norm_url"]).withColumn("is_variant", F.col("url") != F.col("representative"))


def variant_report(resolved: DataFrame, within: list[str]) -> DataFrame:
    """norm_url, representative, variants (sorted, ' | ' between), n_variants."""
    lists = resolved.where("is_variant").groupBy(*within, "norm_url", "representative").agg(F.array_sort(F.collect_set("url")).alias("v"))
    return lists.select(*within, "norm_url", "representative", F.array_join("v", " | ").alias("variants"), F.size("v").alias("n_variants"))


def amp_twins(pages: DataFrame, within: list[str], amphtml: DataFrame | None = None) -> DataFrame:
    """Pages that are AMP variants with base_url and what confirms it.

    pages: url_id, url, canonical_url, signature_hash, and ``within``; amphtml: url_id, base_url of pages another page
    names as its AMP twin.  The shape of an address alone is no proof: its canonical must name the base, or the base
    must have the same signature.
    """
    p = pages.withColumn("key", page_match_key(F.col("url"))).withColumn("shape", amp_base_url(F.col("url")))
    p = p.withColumn("base_key", page_match_key(F.col("shape")))
    hashes = p.where("signature_hash <> ''").groupBy(*within, F.col("key").alias("base_key")).agg(F.max_by("signature_hash", "url_id").alias("base_hash"))
    p = p.join(hashes, [*within, "base_key"], "left")
    named = F.lit(None).cast("string")
    if amphtml is not None:
        p = p.join(amphtml.groupBy("url_id").agg(F.min("base_url").alias("named")), "url_id", "left")
        named = F.col("named")
    why = F.when(named.isNotNull(), "amphtml-target").when(page_match_key(F.col("canonical_url")) == F.col("base_key"), "canonical-to-base").when(F.col("signature_hash") == F.col("base_hash"), "signature-hash")
    found = p.withColumn("confirmed_by", why).withColumn("base", F.coalesce(named, F.col("shape"))).where("confirmed_by is not null and base is not null")
    issue = F.when(F.coalesce(F.trim("canonical_url"), F.lit("")) == "", "missing-canonical").when(page_match_key(F.col("canonical_url")) != page_match_key(F.col("base")), "canonical-not-base").otherwise("")
    return found.select(*within, "url_id", "url", F.col("base").alias("base_url"), "confirmed_by", issue.alias("issue"))


def exclusion_reason() -> Column:
    """Why a page takes no part in pairing; null if it does.  Uses kind, status, overall_indexable, variant_kind, canonical_url, url, variant_of."""
    elsewhere = (F.col("canonical_url") != "") & (normalise_url(F.col("canonical_url")) != normalise_url(F.col("url")))
    return (
        F.when((F.col("kind") != "") & (F.col("kind") != "html"), "non-html").when(F.col("status") != 200, "non-200").when(~F.col("overall_indexable"), "noindex").when(F.col("variant_kind") == "amp", "amp-variant")
        .when(elsewhere, "canonicalised-elsewhere").when(F.col("variant_of") != "", "url-variant")
    )


def url_class() -> Column:
    """``parameterised`` for an address whose query selects something and whose canonical does not name another page."""
    real = query_without_tracking(query_of(F.col("url"))) != ""
    elsewhere = F.coalesce((F.col("canonical_url") != "") & (normalise_url(F.col("canonical_url")) != normalise_url(F.col("url"))), F.lit(False))
    amp = F.coalesce(F.col("variant_kind") == "amp", F.lit(False))
    return F.when(real & ~elsewhere & ~amp, "parameterised")


def parameterised_fold(pages: DataFrame, within: list[str]) -> DataFrame:
    """pages with url_class, excluded and suggested_canonical: parameterised pages of the same signature as their base are folded."""
    p = pages.withColumn("url_class", url_class()).withColumn("excluded", exclusion_reason())
    bases = p.where(query_without_tracking(query_of(F.col("url"))) == "").groupBy(*within, normalise_url(F.col("url")).alias("base_norm")).agg(F.min(F.struct("url", "signature_hash")).alias("b"))
    p = p.withColumn("base_norm", normalise_url(base_url(F.col("url")))).join(bases, [*within, "base_norm"], "left")
    fold = (F.col("url_class") == "parameterised") & F.col("excluded").isNull() & (F.col("b.url") != F.col("url")) & (F.col("signature_hash") == F.col("b.signature_hash"))
    fold = F.coalesce(fold, F.lit(False))
    return p.withColumn("suggested_canonical", F.when(fold, F.col("b.url"))).withColumn("excluded", F.when(fold, "parameterised-duplicate").otherwise(F.col("excluded"))).drop("b", "base_norm")
