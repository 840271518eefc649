"""Address algebra as Column expressions; nothing here leaves generated JVM code.

All functions take and give Columns, map null to null, and never raise on broken input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that identify a visit and never select content.
TRACKING_IDS = ["fbclid", "gclid", "dclid", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid"]
SESSION_IDS = ["ref_src", "sessionid", "session_id", "sid", "phpsessid", "jsessionid"]

_HEAD = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _HEAD, 1))


def netloc_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _HEAD, 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _HEAD + r"([^?#]*)", 3)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def plain_host(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot or a leading ``www.``."""
    return F.regexp_replace(netloc_of(url), r"^.*@|:\d*$|\.+(?=(:\d*)?$)|^www\.", "")


def plain_path(url: Column) -> Column:
    """Lower-case path without doubled slashes, index document or trailing slash."""
    path = F.regexp_replace(F.lower(path_of(url)), r"/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(path, r"/(?:index|default)\.(?:php|html?|aspx?)$", ""), r"/+$", "")


def selecting_query(url: Column) -> Column:
    """Sorted query parameters that may select content, lower-case."""
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    parts = F.filter(
        F.split(F.lower(query_of(url)), "&"),
        lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING_IDS + SESSION_IDS),
    )
    return F.array_join(F.array_sort(F.array_distinct(parts)), "&")


def address_key(url: Column) -> Column:
    """One spelling for all addresses that differ only in writing; null for null or blank."""
    query = selecting_query(url)
    key = F.concat(plain_host(url), plain_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(url) != "", key)


# --- audit normalisation: keeps scheme, port and www., folds writing and tracking ------------

AUDIT_TRACKING = ["gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "dclid", "gbraid", "wbraid"]  # fixed values
INDEX_DOCUMENT = r"/index\.(?:php|html|htm)$"


def _form_coded(text: Column) -> Column:
    """Decoded and coded again as a form would; what can't be decoded is coded as it is."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(text), text))
    return F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_without_tracking(query: Column) -> Column:
    """Parameters in their order, utm_* and click ids dropped, each written as ``key=value``."""
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    value = lambda p: F.regexp_replace(p, r"^[^=]*=?", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(key(p)).startswith("utm_") & ~F.lower(key(p)).isin(AUDIT_TRACKING))
    return F.array_join(F.transform(kept, lambda p: F.concat(_form_coded(key(p)), F.lit("="), _form_coded(value(p)))), "&")


def _audit_path(url: Column) -> Column:
    path = F.regexp_replace(F.lower(path_of(url)), INDEX_DOCUMENT, "/")
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^$", "/")


def normalise_url(url: Column) -> Column:
    """scheme://host/path?query in one writing; '' for null or blank."""
    query = query_without_tracking(query_of(url))
    full = F.concat(scheme_of(url), F.lit("://"), netloc_of(url), _audit_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(url) != "", full).otherwise("")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(_audit_path(url), "/"), lambda x: x != "")


def section_of(url: Column) -> Column:
    return F.coalesce(F.get(path_segments(url), F.lit(0)), F.lit("/"))


def path_depth(url: Column) -> Column:
    return F.size(path_segments(url))


def url_relation(a: Column, b: Column) -> Column:
    """parent-child, sibling, same-section or cross-section by host and path segments."""
    x, y = path_segments(a), path_segments(b)
    n, m = F.size(x), F.size(y)
    short = F.least(n, m)
    head = F.slice(x, 1, short) == F.slice(y, 1, short)
    return (
        F.when(netloc_of(a) != netloc_of(b), "cross-section").when(x == y, "sibling").when((short == 0) | ((n != m) & head), "parent-child")
        .when((n == m) & (n >= 2) & (F.slice(x, 1, F.greatest(n - 1, F.lit(0))) == F.slice(y, 1, F.greatest(m - 1, F.lit(0)))), "sibling")
        .when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), "same-section").otherwise("cross-section")
    )


def base_url(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), F.regexp_extract(F.trim(url), _HEAD, 2), path_of(url))


def in_section(url: Column, section: str) -> Column:
    """Whether the path is the section or below it, by whole segments."""
    prefix = "/" + section.strip().lower().strip("/")
    path = _audit_path(url)
    return F.lit(True) if prefix == "/" else (path == prefix) | path.startswith(prefix + "/")


def time_sequenced(a: Column, b: Column, sections: list[str]) -> Column:
    """``time-sequenced`` if both lie in the same one of the sections, else ''."""
    both = [in_section(a, s) & in_section(b, s) for s in sections]
    return F.when(_any(both), "time-sequenced").otherwise("")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def lang_bucket(code: Column) -> Column:
    return F.when(code != "", F.lower(F.split_part(code, F.lit("-"), F.lit(1)))).otherwise("unknown")


# --- keys of matching, AMP, variants, scope, priority ---------------------------------------


def page_match_key(url: Column) -> Column:
    """Ignores www., fragment and trailing slashes; the case of the path counts."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    query = F.regexp_extract(u, r"(\?.*)$", 1)
    host = F.regexp_replace(netloc_of(u), r"^www\.", "")
    key = F.concat(scheme_of(u), F.lit("://"), host, F.regexp_replace(path_of(u), "/+$", ""), F.when(query == "?", "").otherwise(query))
    return F.regexp_replace(key, "/+$", "")


def redirect_match_key(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash of the path; query and fragment count."""
    rest = F.regexp_extract(F.trim(url), r"^[^?#]*(.*)$", 1)
    return F.when(F.trim(url) != "", F.concat(scheme_of(url), F.lit("://"), netloc_of(url), F.regexp_replace(path_of(url), "/+$", ""), rest)).otherwise("")


def amp_base_url(url: Column) -> Column:
    """The page an AMP-shaped address belongs to (last segment ``amp`` or ``amp=1``), else null."""
    path, query = path_of(url), query_of(url)
    by_path = path.rlike(r"(?i)(?:^|/)amp/*$")
    above = F.regexp_replace(path, r"(?i)/*amp(/*)$", "$1")
    new_path = F.when(~by_path, path).when(F.regexp_replace(above, "/", "") == "", "/").otherwise(F.regexp_replace(above, "/+$", "/"))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    by_query = F.array_contains(parts, "amp=1")
    new_query = F.when(by_query, F.array_join(F.filter(parts, lambda p: p != "amp=1"), "&")).otherwise(query)
    tail = F.regexp_extract(F.trim(url), "(#.*)$", 1)
    full = F.concat(scheme_of(url), F.lit("://"), F.regexp_extract(F.trim(url), _HEAD, 2), new_path, F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""), tail)
    return F.when(by_path | F.coalesce(by_query, F.lit(False)), full)


def url_variants(url: Column) -> Column:
    """Array of struct(kind, variant): spellings a server may or may not treat as the same page."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    head = F.concat(scheme_of(url), F.lit("://"), F.regexp_extract(F.trim(url), _HEAD, 2))
    tail = F.regexp_extract(F.trim(url), r"^[^?#]*(.*)$", 1)
    made = lambda kind, p, test: F.when(test, F.struct(F.lit(kind).alias("kind"), F.concat(head, p, tail).alias("variant")))
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    flipped = F.translate(last, lower + upper, upper + lower)
    case_path = F.concat(F.regexp_replace(path, r"[^/]+/*$", ""), flipped, F.when(path.endswith("/"), "/").otherwise(""))
    kinds = [made("trailing_slash", F.concat(path, F.lit("/")), ~path.endswith("/"))]
    kinds += [made(f"suffix_{x}", F.concat(path, F.lit(f".{x}")), ~F.lower(path).endswith(f".{x}")) for x in ("php", "html", "aspx")]
    kinds.append(made("case", case_path, (last != "") & (flipped != last)))
    return F.array_compact(F.array(*kinds))


def variant_verdict(status: Column, location: Column, canonical_seen: Column, canonical: Column) -> Column:
    """What an answer to a variant says: duplicate, absent or investigate."""
    same = F.when(status.between(300, 399), location == canonical).when(status == 200, canonical_seen == canonical)
    return F.when(same, "duplicate").when(status == 404, "absent").otherwise("investigate")


def skip_reason(url: Column, exclude: list[str], only: str | None = None) -> Column:
    """path_exclude (prefix), path_restriction (substring missing) or ''."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    out = F.when(_any([path.startswith(p if p.startswith("/") else f"/{p}") for p in exclude]), "path_exclude")
    if only:
        out = out.when(~path.contains(only), "path_restriction")
    return out.otherwise("")


def reject_reason(url: Column, hosts: list[str], exclude: list[str], only: str | None = None) -> Column:
    """Why an address must not be fetched, the first reason of a fixed order; null if it may be."""
    scheme, netloc, path_reason = scheme_of(url), netloc_of(url), skip_reason(url, exclude, only)
    return (
        F.when(~scheme.isin("http", "https") & (scheme != ""), "unsupported_scheme").when((scheme == "") | (netloc == ""), "malformed_url").when(netloc.contains("@"), "credential_url")
        .when(~netloc.isin([h.lower() for h in hosts]), "host_out_of_scope").when(path_reason != "", path_reason)
    )


def priority_score(url: Column, depth: Column) -> Column:
    path = path_of(url)
    n = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return F.lit(100.0) - depth * 5.0 - n * 2.0 - F.when(query_of(url) != "", 10.0).otherwise(0.0) - F.when(path.rlike(r"\.(?:jpg|png|pdf|zip)$"), 20.0).otherwise(0.0)


def clean_archive_url(url: Column, extensions: list[str], paths: list[str], https: bool = False, www: bool = False) -> Column:
    """An archived address without nested prefix or port; null for mail links, static files and given paths."""
    u = F.trim(url)
    nested = F.regexp_extract(u, r"^[^:]*://.*?://(.*)$", 1)
    u = F.when(u.rlike(r"://.*://"), F.when(nested.contains("://"), nested).otherwise(F.concat(F.lit("https://"), nested))).otherwise(u)
    path = F.when(path_of(u) == "", "/").otherwise(path_of(u))
    netloc = F.regexp_replace(F.regexp_extract(u, _HEAD, 2), r":\d+$", "")
    scheme = F.lit("https") if https else F.when(scheme_of(u) == "", "https").otherwise(scheme_of(u))
    if www:
        netloc = F.when(netloc.startswith("www."), netloc).otherwise(F.concat(F.lit("www."), netloc))
    drop = _any([F.lower(path).endswith(x) for x in extensions] + [F.lower(path).startswith(x.lower()) for x in paths])
    full = F.concat(scheme, F.lit("://"), netloc, path, F.regexp_extract(u, r"^[^?#]*(.*)$", 1))
    return F.when((u != "") & ~u.startswith("mailto:") & ~drop, full)


def remapped(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; null stays null."""
    for old, new in replacements:
        if not old:
            raise ValueError("the text to replace is empty")
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replacements_from(specs: list[str]) -> list[tuple[str, str]]:
    """``FROM=TO`` texts as pairs; TO may hold further ``=``."""
    for s in specs:
        if "=" not in s or s.startswith("="):
            raise ValueError(f"not FROM=TO: {s!r}")
    return [tuple(s.split("=", 1)) for s in specs]


def user_agent_for(url: Column, by_domain: dict[str, str], default: str) -> Column:
    """The agent of the first domain that is the host or above it."""
    host = F.regexp_replace(netloc_of(url), r"^.*@|:\d*$", "")
    out = F.lit(default)
    for domain, agent in reversed(by_domain.items()):
        out = F.when((host == domain.lower()) | host.endswith("." + domain.lower()), agent).otherwise(out)
    return out
