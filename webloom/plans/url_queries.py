"""Address algebra, fingerprints, signatures and identity over the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.operators import identity
from webloom.operators.components import connected_components
from webloom.plans.tables import table
from webloom.scratch import Scratch


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest row of each (run_id, url_id) of analysis_rows."""
    rows = table(spark, d, "analysis_rows").where("run_id is not null and url_id is not null")
    best = F.max(F.struct("fetched_at", "loaded_at", *columns)).alias("best")
    return rows.groupBy("run_id", "url_id").agg(best).select("run_id", "url_id", *(f"best.{c}" for c in columns))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_rows").select("url").where("url is not null").distinct()


def url_normalise(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", urls.normalise_url(u).alias("norm_url"), urls.section_of(u).alias("section"), urls.path_depth(u).alias("depth"))


def url_sections(spark, d):
    return _urls(spark, d).groupBy(urls.netloc_of(F.col("url")).alias("host"), urls.section_of(F.col("url")).alias("section")).agg(F.count("*").alias("n"))


def url_relations(spark, d):
    """How each address stands to the canonical its page names."""
    pairs = table(spark, d, "analysis_rows").select("url", "canonical_url").where("url <> '' and trim(canonical_url) <> ''").distinct()
    return pairs.withColumn("relation", urls.url_relation(F.col("url"), F.col("canonical_url")))


def url_match_keys(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", urls.page_match_key(u).alias("page_key"), urls.redirect_match_key(u).alias("redirect_key"), urls.amp_base_url(u).alias("amp_base"))


def url_generate_variants(spark, d):
    each = _urls(spark, d).select("url", F.explode(urls.url_variants(F.col("url"))).alias("v"))
    return each.select("url", "v.kind", "v.variant")


def url_scope(spark, d):
    """Why addresses are out of scope, for one set of rules."""
    reason = urls.reject_reason(F.col("url"), ["shop.brindlemoor.example", "inlet-house-a0.example", "amber-loft-a6.example"], ["/blog", "faq"], "e")
    return _urls(spark, d).select("url", F.coalesce(reason, F.lit("")).alias("reason"))


def url_priority(spark, d):
    """The fifty addresses to fetch first."""
    score = urls.priority_score(F.col("url"), urls.path_depth(F.col("url")))
    return _urls(spark, d).select("url", score.alias("score")).orderBy(F.desc("score"), "url").limit(50)


def url_archive_clean(spark, d):
    clean = urls.clean_archive_url(F.col("url"), [".htm", ".pdf"], ["/print"], https=True, www=True)
    return _urls(spark, d).select("url", clean.alias("clean")).where("clean is not null")


def url_remap(spark, d):
    return _urls(spark, d).select("url", urls.remapped(F.col("url"), [("http://", "https://"), (".example", ".test")]).alias("remapped"))


def url_parameterised(spark, d):
    return records(spark, d, "url", "canonical_url", "variant_kind").select("run_id", "url_id", F.coalesce(identity.url_class(), F.lit("")).alias("url_class"))


def doc_exact_dups(spark, d):
    """Groups of equal texts, by digest."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def doc_simhash(spark, d):
    return text.simhash64(table(spark, d, "documents"), "doc_id", "text")


def simhash_near_dups(spark, d):
    """Each document with the class of its near fingerprints and the number of other fingerprints four bits away at most."""
    prints = Scratch(spark).cut(doc_simhash(spark, d), "prints")
    near = Scratch(spark).cut(text.near_links(prints, "simhash"), "near")
    ends = near.groupBy(F.col("h").alias("simhash")).agg(F.sum("n").alias("n_links"))
    classes = connected_components(near.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("simhash"), F.col("component").alias("class_id"))
    out = prints.join(ends, "simhash", "left").join(classes, "simhash", "left")
    return out.select("doc_id", F.coalesce("class_id", "simhash").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def simhash_neighbours(spark, d):
    """Rows within eight bits of the smallest fingerprint, nearest first."""
    rows = table(spark, d, "page_run_snapshots").where("content_hash_simhash is not null").select("run_id", "url_id", "content_hash_simhash").distinct()
    target = rows.agg(F.min("content_hash_simhash").alias("target"))  # one row
    near = rows.crossJoin(F.broadcast(target)).withColumn("distance", text.hamming(F.col("content_hash_simhash"), F.col("target")).cast("int"))
    return near.where("distance <= 8").select("run_id", "url_id", "distance").orderBy("distance", "run_id", "url_id")


def _page_titles(spark, d):
    rows = table(spark, d, "analysis_rows").where("url is not null")
    return rows.select("run_id", "url_id", "url", "title").distinct()


def title_boilerplate(spark, d):
    return text.title_boilerplate(_page_titles(spark, d), 0.05)


def signature_hashes(spark, d):
    """Signature of each record without its site's title boilerplate, and its digest."""
    recs = records(spark, d, "url", "title", "h1", "main_text").withColumn("site", urls.netloc_of(F.col("url")))
    recs = recs.join(text.title_boilerplate(_page_titles(spark, d), 0.05), "site", "left")
    clean = lambda c: text.without_boilerplate(F.col(c), F.col("prefix"), F.col("suffix"))
    sig = text.signature_text(clean("title"), clean("h1"), F.lit(None).cast("string"), F.col("main_text"))
    return recs.select("run_id", "url_id", sig.alias("sig")).select("run_id", "url_id", text.word_count(F.col("sig")).alias("words"), F.sha2("sig", 256).alias("sha256"))


def signature_quality(spark, d):
    recs = records(spark, d, "signature_model_input", "word_count", "extraction_method")
    sig = F.col("signature_model_input")
    return recs.select("run_id", "url_id", text.word_count(sig).alias("signature_words"), text.is_thin(sig).alias("thin"), text.signal_confidence(F.col("word_count"), F.col("extraction_method")).alias("confidence"))


def lang_buckets(spark, d):
    return table(spark, d, "hreflang_identity").select(urls.lang_bucket(F.col("resolved_hreflang_code")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def _edges(spark, d):
    """Each page of a group names the group's first page."""
    pages = table(spark, d, "hreflang_identity").where("hreflang_group is not null and norm_url is not null").select("run_id", "hreflang_group", F.col("norm_url").alias("url"), F.col("resolved_hreflang_code").alias("code")).distinct()
    first = pages.groupBy("run_id", "hreflang_group").agg(F.min(F.struct("url", "code")).alias("f"))
    return pages.join(first, ["run_id", "hreflang_group"]).select("url", F.col("f.url").alias("alt_url"), F.col("f.code").alias("code"))


def hreflang_groups(spark, d):
    return identity.hreflang_groups(_edges(spark, d)).select("norm_url", "hreflang_group", F.coalesce("declared", F.lit("")).alias("declared"))


def hreflang_reciprocity(spark, d):
    return identity.reciprocity_issues(_edges(spark, d))


def hreflang_summary(spark, d):
    rows = table(spark, d, "hreflang_identity").where("hreflang_group is not null")
    return rows.groupBy("run_id").agg(F.countDistinct("hreflang_group").alias("n_groups"), F.countDistinct("url_id").alias("n_urls"))


def _pages(spark, d):
    rows = table(spark, d, "identity_pages").where("url is not null").select("run_id", "url_id", "url", "status", "word_count", "final_url").distinct()
    return rows.withColumn("norm_url", urls.normalise_url(F.col("url"))).withColumn("redirected", F.coalesce(F.col("final_url") != F.col("url"), F.lit(False)))


def url_variants_resolve(spark, d):
    return identity.variants(_pages(spark, d), ["run_id"]).select("run_id", "url_id", "norm_url", "representative", "n_members", "is_variant")


def url_variant_report(spark, d):
    return identity.variant_report(identity.variants(_pages(spark, d), ["run_id"]), ["run_id"])


_EXCLUSION = ["url", "kind", "status", "overall_indexable", "variant_kind", "canonical_url", "variant_of"]


def exclusion_reasons(spark, d):
    return records(spark, d, *_EXCLUSION).select("run_id", F.coalesce(identity.exclusion_reason(), F.lit("")).alias("reason")).groupBy("run_id", "reason").agg(F.count("*").alias("n"))


def parameterised_fold(spark, d):
    out = identity.parameterised_fold(records(spark, d, *_EXCLUSION, "signature_hash"), ["run_id"])
    return out.select("run_id", "url_id", F.coalesce("url_class", F.lit("")).alias("url_class"), F.coalesce("excluded", F.lit("")).alias("excluded"), F.coalesce("suggested_canonical", F.lit("")).alias("suggested_canonical"))


def amp_twins(spark, d):
    return identity.amp_twins(records(spark, d, "url", "canonical_url", "signature_hash").where("url is not null"), ["run_id"])


QUERIES = {
    f.__name__: f
    for f in (
        url_normalise, url_sections, url_relations, url_match_keys, url_generate_variants, url_scope, url_priority, url_archive_clean, url_remap, url_parameterised, doc_exact_dups, doc_simhash, simhash_near_dups,
        simhash_neighbours, title_boilerplate, signature_hashes, signature_quality, lang_buckets, hreflang_groups, hreflang_reciprocity, hreflang_summary, url_variants_resolve, url_variant_report, exclusion_reasons, parameterised_fold, amp_twins,
    )
}

# --- the same in SQL ------------------------------------------------------------------------


def _scheme(u):
    return rf"lower(regexp_extract(trim({u}), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?', 1))"


def _netloc(u):
    return rf"lower(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def _path(u):
    return rf"regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _query(u):
    return rf"regexp_extract(trim({u}), '^[^?#]*\?([^#]*)', 1)"


def _clean_query(u):
    keep = "x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_') and lower(split_part(x, '=', 1)) not in ('gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'dclid', 'gbraid', 'wbraid')"
    return f"coalesce(list_aggregate(list_transform(list_filter(string_split({_query(u)}, '&'), lambda x: {keep}), lambda x: url_encode(url_decode(split_part(x, '=', 1))) || '=' || url_encode(url_decode(regexp_replace(x, '^[^=]*=?', '')))), 'string_agg', '&'), '')"


def _npath(u):
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({_path(u)}), '/index\.(php|html|htm)$', '/'), '/+$', ''), '^$', '/')"


def _norm(u):
    return f"case when trim({u}) <> '' then {_scheme(u)} || '://' || {_netloc(u)} || {_npath(u)} || case when {_clean_query(u)} <> '' then '?' || {_clean_query(u)} else '' end else '' end"


def _segments(u):
    return f"list_filter(string_split({_npath(u)}, '/'), lambda x: x <> '')"


def _page_key(u):
    v = f"regexp_replace(trim({u}), '#.*$', '')"
    return rf"regexp_replace({_scheme(v)} || '://' || regexp_replace({_netloc(v)}, '^www\.', '') || regexp_replace({_path(v)}, '/+$', '') || regexp_replace(regexp_extract({v}, '(\?.*)$', 1), '^\?$', ''), '/+$', '')"


def _amp(u):
    path, query = _path(u), _query(u)
    head = rf"{_scheme(u)} || '://' || regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    above = rf"regexp_replace({path}, '(?i)/*amp(/*)$', '\1')"
    by_path, by_query = f"regexp_matches({path}, '(?i)(^|/)amp/*$')", f"list_contains(string_split({query}, '&'), 'amp=1')"
    rest = f"case when {by_query} then coalesce(list_aggregate(list_filter(string_split({query}, '&'), lambda x: x <> '' and x <> 'amp=1'), 'string_agg', '&'), '') else {query} end"
    new_path = f"case when not {by_path} then {path} when replace({above}, '/', '') = '' then '/' else regexp_replace({above}, '/+$', '/') end"
    return f"case when {by_path} or {by_query} then {head} || ({new_path}) || case when ({rest}) <> '' then '?' || ({rest}) else '' end || regexp_extract(trim({u}), '(#.*)$', 1) end"


_RECS = """recs as (
  select * exclude (pick) from (select *, row_number() over (partition by run_id, url_id order by fetched_at desc nulls last, loaded_at desc) as pick
  from analysis_rows where run_id is not null and url_id is not null) where pick = 1)"""
_URLS = "urls as (select distinct url from analysis_rows where url is not null)"
_SPLITS = [s.replace("'", "''") for s in text.TITLE_SPLITS]


def _part(last: bool) -> str:
    cases = " ".join(f"when contains(title, '{s}') then trim(string_split(title, '{s}')[{-1 if last else 1}])" for s in _SPLITS)
    return f"case {cases} else '' end"


_BOILER = f"""titles as (select {_netloc("url")} as site, title from (select distinct run_id, url_id, url, title from analysis_rows where url is not null and title is not null)),
parts as (
  select site, 'prefix' as kind, {_part(False)} as part from titles union all select site, 'suffix', {_part(True)} from titles),
counted as (select site, kind, part, count(*) as n from parts where part <> '' group by 1, 2, 3),
best as (select * from counted qualify row_number() over (partition by site, kind order by n desc, part) = 1),
boiler as (
  select b.site, max(case when kind = 'prefix' then part end) as prefix, max(case when kind = 'suffix' then part end) as suffix
  from best b join (select site, count(*) as titles from titles group by 1 having count(*) >= 2) s using (site) where n / titles > 0.05 group by 1)"""


def _stripped(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    ahead = " ".join(f"when starts_with({t}, prefix || '{s}') then trim(substr({t}, strpos({t}, '{s}') + {len(s)}))" for s in text.TITLE_SPLITS)
    a = f"(case when coalesce(prefix, '') = '' then {t} when {t} = prefix then '' {ahead} else {t} end)"
    tail = " ".join(f"when ends_with({a}, '{s}' || suffix) then trim(substr({a}, 1, length({a}) - length(suffix) - {len(s)}))" for s in text.TITLE_SPLITS)
    return f"(case when coalesce(suffix, '') = '' then {a} when {a} = suffix then '' {tail} else {a} end)"


_EDGES = """pages as (select distinct run_id, hreflang_group as g, norm_url as url, resolved_hreflang_code as code from hreflang_identity where hreflang_group is not null and norm_url is not null),
firsts as (select run_id, g, arg_min(url, url) as alt_url, min(code) filter (where url = m) as code from (select *, min(url) over (partition by run_id, g) as m from pages) group by 1, 2),
edges as (select p.url, f.alt_url, f.code from pages p join firsts f using (run_id, g))"""
_IDENTITY = f"""pages as (
  select *, {_norm("url")} as norm_url, coalesce(final_url <> url, false) as redirected from (select distinct run_id, url_id, url, status, word_count, final_url from identity_pages where url is not null)),
ranked as (
  select *, count(*) over (partition by run_id, norm_url) as n_members,
    first_value(url) over (partition by run_id, norm_url order by redirected, coalesce(status = 200, false) desc, coalesce(word_count, 0) desc, length(url), url) as representative from pages),
resolved as (select *, url <> representative as is_variant from ranked where n_members > 1)"""
_ELSEWHERE = f"(coalesce(canonical_url, '') <> '' and {_norm('canonical_url')} <> {_norm('url')})"
_EXCLUDED = f"case when kind <> '' and kind <> 'html' then 'non-html' when status <> 200 then 'non-200' when not overall_indexable then 'noindex' when variant_kind = 'amp' then 'amp-variant' when {_ELSEWHERE} then 'canonicalised-elsewhere' when variant_of <> '' then 'url-variant' end"
_CLASS = f"case when {_clean_query('url')} <> '' and not {_ELSEWHERE} and coalesce(variant_kind, '') <> 'amp' then 'parameterised' else '' end"
_REL = f"""case when {_netloc("url")} <> {_netloc("canonical_url")} then 'cross-section' when x = y then 'sibling'
  when len(x) = 0 or len(y) = 0 or (len(x) <> len(y) and x[1:least(len(x), len(y))] = y[1:least(len(x), len(y))]) then 'parent-child'
  when len(x) = len(y) and len(x) >= 2 and x[1:len(x) - 1] = y[1:len(y) - 1] then 'sibling' when x[1] = y[1] then 'same-section' else 'cross-section' end"""
_VPATH = f"regexp_replace({_path('url')}, '^$', '/')"
_VHEAD = rf"{_scheme('url')} || '://' || regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_VTAIL = "regexp_extract(trim(url), '^[^?#]*(.*)$', 1)"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = f"regexp_extract({_VPATH}, '([^/]+)/*$', 1)"
_FLIP = f"translate({_LAST}, '{_LOWER + _UPPER}', '{_UPPER + _LOWER}')"
_SIG = f"array_to_string(list_filter([{_stripped('title')}, {_stripped('h1')}, substr(trim(coalesce(main_text, '')), 1, 1500)], lambda x: x <> ''), chr(10))"
_WORDS = r"case when trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) end"

_SIMHASH = r"""with words as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) as w from documents),
counted as (select doc_id, ('0x' || substr(md5(w), 1, 16))::ubigint as h, count(*) as n from words group by 1, 2),
sums as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) as s from counted, range(64) t(b) group by 1, 2),
prints as (select doc_id, bit_or(case when s >= 0 then 1::ubigint << b else 0::ubigint end) as u from sums group by 1)
select d.doc_id, cast(coalesce(case when u >= 9223372036854775808 then cast(u as hugeint) - 18446744073709551616 else u end, 0) as bigint) as simhash from documents d left join prints using (doc_id)"""

SQL = {
    "url_normalise": f"with {_URLS} select url, {_norm('url')} as norm_url, coalesce(({_segments('url')})[1], '/') as section, cast(len({_segments('url')}) as int) as depth from urls",
    "url_sections": f"with {_URLS} select {_netloc('url')} as host, coalesce(({_segments('url')})[1], '/') as section, count(*) as n from urls group by 1, 2",
    "url_relations": f"select url, canonical_url, {_REL} as relation from (select *, {_segments('url')} as x, {_segments('canonical_url')} as y from (select distinct url, canonical_url from analysis_rows where url <> '' and trim(canonical_url) <> ''))",
    "url_match_keys": f"with {_URLS} select url, {_page_key('url')} as page_key, {_scheme('url')} || '://' || {_netloc('url')} || regexp_replace({_path('url')}, '/+$', '') || {_VTAIL} as redirect_key, {_amp('url')} as amp_base from urls",
    "url_generate_variants": f"""with {_URLS}
select url, 'trailing_slash' as kind, {_VHEAD} || {_VPATH} || '/' || {_VTAIL} as variant from urls where not ends_with({_VPATH}, '/')
"""
    + "".join(f"union all select url, 'suffix_{x}', {_VHEAD} || {_VPATH} || '.{x}' || {_VTAIL} from urls where not ends_with(lower({_VPATH}), '.{x}')\n" for x in ("php", "html", "aspx"))
    + f"union all select url, 'case', {_VHEAD} || regexp_replace({_VPATH}, '[^/]+/*$', '') || {_FLIP} || case when ends_with({_VPATH}, '/') then '/' else '' end || {_VTAIL} from urls where {_LAST} <> '' and {_FLIP} <> {_LAST}",
    "url_scope": f"""with {_URLS} select url, case when {_scheme('url')} not in ('http', 'https', '') then 'unsupported_scheme' when {_scheme('url')} = '' or {_netloc('url')} = '' then 'malformed_url' when contains({_netloc('url')}, '@') then 'credential_url'
  when {_netloc('url')} not in ('shop.brindlemoor.example', 'inlet-house-a0.example', 'amber-loft-a6.example') then 'host_out_of_scope'
  when starts_with({_VPATH}, '/blog') or starts_with({_VPATH}, '/faq') then 'path_exclude' when not contains({_VPATH}, 'e') then 'path_restriction' else '' end as reason from urls""",
    "url_priority": f"""with {_URLS} select url, 100.0::double - 5 * len({_segments('url')}) - 2 * len(list_filter(string_split({_path('url')}, '/'), lambda x: x <> '')) - case when {_query('url')} <> '' then 10 else 0 end
  - case when regexp_matches({_path('url')}, '\\.(jpg|png|pdf|zip)$') then 20 else 0 end as score from urls order by score desc, url limit 50""",
    "url_archive_clean": f"""with {_URLS} select url, 'https://' || case when starts_with(h, 'www.') then h else 'www.' || h end || {_VPATH} || {_VTAIL} as clean
from (select url, regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ':\\d+$', '') as h from urls)
where not ends_with(lower({_VPATH}), '.htm') and not ends_with(lower({_VPATH}), '.pdf') and not starts_with(lower({_VPATH}), '/print')""",
    "url_remap": f"with {_URLS} select url, replace(replace(url, 'http://', 'https://'), '.example', '.test') as remapped from urls",
    "url_parameterised": f"with {_RECS} select run_id, url_id, {_CLASS} as url_class from recs",
    "doc_exact_dups": "select sha256(text) as sha256, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
    "doc_simhash": _SIMHASH,
    "simhash_near_dups": f"""with recursive f as ({_SIMHASH}), s as (select distinct simhash as h from f),
e as (select x.h as a, y.h as b from s x join s y on x.h <> y.h and bit_count(xor(x.h, y.h)) <= 4),
reach as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
classes as (select a, least(a, min(b)) as c from reach group by a), links as (select a, count(*) as n from e group by a)
select doc_id, coalesce(c, simhash) as class_id, coalesce(n, 0) as n_links from f left join classes on classes.a = simhash left join links on links.a = simhash""",
    "simhash_neighbours": """with r as (select distinct run_id, url_id, content_hash_simhash as h from page_run_snapshots where content_hash_simhash is not null)
select run_id, url_id, cast(bit_count(xor(h, (select min(h) from r))) as int) as distance from r where bit_count(xor(h, (select min(h) from r))) <= 8""",
    "title_boilerplate": f"with {_BOILER} select site, prefix, suffix from boiler",
    "signature_hashes": f"""with {_RECS}, {_BOILER},
sigs as (select run_id, url_id, {_SIG} as sig from (select *, {_netloc('url')} as site from recs) left join boiler using (site))
select run_id, url_id, cast({_WORDS.format('sig')} as int) as words, sha256(sig) as sha256 from sigs""",
    "signature_quality": f"""with {_RECS}, w as (select *, {_WORDS.format('signature_model_input')} as n from recs)
select run_id, url_id, cast(n as int) as signature_words, signature_model_input is not null and n < 88 as thin, case when coalesce(word_count, 0) < 50 or coalesce(extraction_method, '') = 'fallback' then 'low' else 'high' end as confidence from w""",
    "lang_buckets": "select case when resolved_hreflang_code <> '' then lower(split_part(resolved_hreflang_code, '-', 1)) else 'unknown' end as bucket, count(*) as n from hreflang_identity group by 1",
    "hreflang_groups": f"""with recursive {_EDGES},
e as (select {_norm('url')} as a, {_norm('alt_url')} as b, code from edges), und as (select a, b from e union select b, a from e),
reach as (select a as x, a as y from und union select r.x, u.b from reach r join und u on r.y = u.a),
comp as (select x, min(y) as c, count(*) as n from reach group by 1), named as (select c, printf('H%04d', row_number() over (order by c) - 1) as g from (select distinct c from comp where n > 1)),
lang as (select b, min(code) as code from e where code <> '' and code <> 'x-default' group by 1)
select x as norm_url, g as hreflang_group, coalesce(code, '') as declared from comp join named using (c) left join lang on b = x""",
    "hreflang_reciprocity": f"""with {_EDGES}, e as (select *, {_norm('url')} as a, {_norm('alt_url')} as b from edges)
select url, alt_url as declares_alternate, coalesce(code, '') as hreflang, 'no return link from alternate' as issue from e where a <> b and not exists (select 1 from e f where f.a = e.b and f.b = e.a)""",
    "hreflang_summary": "select run_id, count(distinct hreflang_group) as n_groups, count(distinct url_id) as n_urls from hreflang_identity where hreflang_group is not null group by 1",
    "url_variants_resolve": f"with {_IDENTITY} select run_id, url_id, norm_url, representative, n_members, is_variant from resolved",
    "url_variant_report": f"""with {_IDENTITY}, v as (select distinct run_id, norm_url, representative, url from resolved where is_variant)
select run_id, norm_url, representative, string_agg(url, ' | ' order by url) as variants, cast(count(*) as int) as n_variants from v group by 1, 2, 3""",
    "exclusion_reasons": f"with {_RECS} select run_id, coalesce({_EXCLUDED}, '') as reason, count(*) as n from recs group by 1, 2",
    "parameterised_fold": f"""with {_RECS}, p as (select *, {_CLASS} as url_class, {_EXCLUDED} as excluded, {_norm('url')} as norm, {_clean_query('url')} as q from recs),
bases as (select run_id, norm, arg_min(url, url) as base, arg_min(coalesce(signature_hash, ''), url || chr(0) || coalesce(signature_hash, '')) as sig from p where q = '' group by 1, 2),
m as (select p.*, b.base, coalesce(p.url_class = 'parameterised' and p.excluded is null and b.base <> p.url and p.signature_hash = b.sig, false) as fold
  from p left join bases b on b.run_id = p.run_id and b.norm = split_part(p.norm, '?', 1))
select run_id, url_id, url_class, case when fold then 'parameterised-duplicate' else coalesce(excluded, '') end as excluded, case when fold then base else '' end as suggested_canonical from m""",
    "amp_twins": f"""with {_RECS}, p as (select *, {_page_key('url')} as key, {_amp('url')} as base from recs where url is not null),
q as (select *, {_page_key('base')} as base_key, {_page_key('canonical_url')} as canonical_key from p),
h as (select run_id, key, arg_max(signature_hash, url_id) as base_hash from p where signature_hash <> '' group by 1, 2),
m as (select q.*, case when canonical_key = base_key then 'canonical-to-base' when signature_hash = base_hash then 'signature-hash' end as confirmed_by from q left join h on h.run_id = q.run_id and h.key = q.base_key)
select run_id, url_id, url, base as base_url, confirmed_by, case when coalesce(trim(canonical_url), '') = '' then 'missing-canonical' when canonical_key <> base_key then 'canonical-not-base' else '' end as issue from m where confirmed_by is not null and base is not null""",
}
