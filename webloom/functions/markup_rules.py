"""What structured data must hold, as tables that one function evaluates.

A rule names the types it is for, what of an item fails it, its message and severity.  A firm rule sets
the severity of the item, the last one that fails counting; a soft rule only lifts an item that no firm rule has failed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from webloom.functions import markup


class Rule(NamedTuple):
    kind: str  # lower case, "" for all types
    failures: Callable[[dict], Iterator[str]]  # the message of each failure
    severity: str
    firm: bool


def _when(message: str, fails: Callable[[dict], Any]) -> Callable[[dict], Iterator[str]]:
    return lambda item: iter([message] if fails(item) else [])


def _text(item: dict, field: str) -> str | None:
    return item[field] if isinstance(item.get(field), str) else None


def _addresses(item: dict) -> Iterator[str]:
    for field, value in item.items():
        if "url" in field.lower() and isinstance(value, str) and not re.match(r"https?://|/", value):
            yield f"Invalid URL format for {field}: {value}"


# Required properties, messages and severities.
REQUIRED = {
    "Article": ["headline", "author"],
    "Product": ["name", "offers"],
    "Organization": ["name"],
    "BreadcrumbList": ["itemListElement"],
    "VideoObject": ["name", "description"],
}
VIDEO = [
    ("VideoObject embedUrl contains HTML entities that should be decoded", "warning", True, lambda x: re.search("&#038;|&amp;", _text(x, "embedUrl") or "")),
    ("VideoObject embedUrl should be a valid HTTP/HTTPS URL", "error", True, lambda x: not re.match("https?://", _text(x, "embedUrl") or "http://")),
    ("VideoObject uploadDate should be a valid ISO 8601 date string", "warning", True, lambda x: "uploadDate" in x and len(_text(x, "uploadDate") or "") < 10),
    ("VideoObject missing 'thumbnailUrl' - CRITICAL for rich results eligibility", "critical", True, lambda x: not {"thumbnailUrl", "image"} & x.keys()),
    ("VideoObject missing 'duration' property (recommended for rich results)", "warning", False, lambda x: "duration" not in x),
]
RULES = [
    *(Rule(kind.lower(), _when(f"{kind} missing required '{f}' property", lambda x, f=f: not x.get(f)), "error", True) for kind, fields in REQUIRED.items() for f in fields),
    *(Rule("videoobject", _when(message, fails), severity, firm) for message, severity, firm, fails in VIDEO),
    Rule("", _addresses, "warning", False),
]


def verdict(item: dict, kind: str) -> tuple[list[str], str]:
    """Messages of the rules an item fails, in the order of the table, and its severity."""
    failed = [(message, rule) for rule in RULES if rule.kind in ("", kind.lower()) for message in rule.failures(item)]
    by_weight = sorted((rule.firm, n) for n, (_, rule) in enumerate(failed))  # firm ones last, the last of them at the end
    firm = by_weight and by_weight[-1][0]
    at = by_weight[-1][1] if firm else 0
    return [message for message, _ in failed], failed[at][1].severity if failed else "info"


class Claim(NamedTuple):
    """Markup that means to be structured data: which places of a page make the claim, and when it is broken."""

    form: str
    name: str
    message: str
    places: Callable[[markup.Element], list]
    broken: Callable[[Any], Any]
    raw: Callable[[Any], str]
    keep: int | None  # characters of the source that are kept


_NAMED = re.compile(r"https?://schema\.org/[A-Za-z]+", re.I)
_elements = lambda test: lambda root: [e for e in root.walk() if test(e)]
_is_ld = lambda e: "application/ld+json" in e.attrs.get("type", "")


def _spoiled(e: markup.Element) -> bool:
    source = e.source()
    return all(w in source for w in ("@context", "@type")) and "schema.org" in source.lower() and not markup.is_json(source)


# Form, name and message.
CLAIMS = [
    Claim("json-ld", "BrokenJSON-LD", "Malformed JSON-LD: Invalid JSON syntax", _elements(lambda e: e.tag == "script" and e.attrs.get("type") == "application/ld+json"), _spoiled, lambda e: e.source(), None),
    Claim("microdata", "BrokenMicrodata", "Malformed microdata: itemscope without valid itemtype", _elements(lambda e: "itemscope" in e.attrs), lambda e: "schema.org" not in e.attrs.get("itemtype", ""), lambda e: e.outer(), 500),
    Claim("rdfa", "BrokenRDFa", "Malformed RDFa: typeof without valid schema.org vocab", _elements(lambda e: "typeof" in e.attrs), lambda e: not e.attrs["typeof"] or "schema.org" not in e.attrs["typeof"] + " " + e.attrs.get("vocab", ""), lambda e: e.outer(), 500),
    Claim("meta", "BrokenMetaSchema", "Schema.org reference in meta tag without proper structure", _elements(lambda e: e.tag == "meta"), lambda e: _NAMED.search(next((e.attrs[k] for k in ("content", "property", "name") if e.attrs.get(k)), "")), lambda e: e.outer(), None),
    Claim("comment", "BrokenCommentSchema", "Schema.org reference in comment without proper structure", lambda root: [s for s in root.said if "schema.org" in s], _NAMED.search, str, 200),
    Claim("json-ld", "BrokenScriptSchema", "JSON-LD content in script tag without proper type attribute", _elements(lambda e: e.tag == "script"), lambda e: not _is_ld(e) and re.search("@context|@type", e.source()), lambda e: e.source(), 500),
]


def broken(root: markup.Element) -> Iterator[tuple[str, str, str, int, str]]:
    """(form, name, message, place, source) of broken claims; places are counted per claim."""
    for claim in CLAIMS:
        for n, place in enumerate(claim.places(root)):
            if claim.broken(place):
                yield claim.form, claim.name, claim.message, n, claim.raw(place)[: claim.keep]
