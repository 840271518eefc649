"""Extraction rules by CSS or XPath, the common part of both, over the element tree.

CSS: tag, *, #id, .class, [attr], [attr=v], ^= $= *= ~=, :first-child, :last-child, :nth-child(n), descendant, ``>``, ``+``,
``~`` and lists.  XPath: / and // steps, *, ., .., [n], [last()], [@a], [@a='v'], [contains(@a,'v')], [text()='v'], and a last
step @attr or text().  Anything else is an error when the rule is made, not when a page is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from webloom.functions.html import UNSEEN, Element, parse

_SIMPLE = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\]|:[a-z-]+(?:\(\d+\))?)*)$")
_PIECE = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|:([a-z-]+)(?:\((\d+)\))?")
_STEP = re.compile(r"(//?)(\*|\.\.?|@[\w:-]+|text\(\)|[A-Za-z][\w-]*)((?:\[[^\]]+\])*)")


def _kids(e: Element) -> list[Element]:
    return [c for c in e.children if isinstance(c, Element)]


def _place(e: Element) -> tuple[list[Element], int]:
    kin = _kids(e.parent) if e.parent else [e]
    return kin, next(i for i, c in enumerate(kin) if c is e)


def _attribute_test(name: str, op: str | None, value: str):
    tests = {None: lambda v: True, "=": lambda v: v == value, "^=": lambda v: v.startswith(value), "$=": lambda v: v.endswith(value), "*=": lambda v: value in v, "~=": lambda v: value in v.split()}
    return lambda e: name in e.attrs and tests[op](e.attrs[name])


def _compound(text: str):
    m = _SIMPLE.match(text)
    if not m or not text:
        raise ValueError(f"not a selector: {text!r}")
    tests = []
    if m[1] and m[1] != "*":
        tests.append(lambda e, t=m[1].lower(): e.tag == t)
    for hid, cls, attr, op, value, pseudo, n in _PIECE.findall(m[2]):
        if hid:
            tests.append(lambda e, v=hid: e.attrs.get("id") == v)
        elif cls:
            tests.append(lambda e, v=cls: v in e.attrs.get("class", "").split())
        elif attr:
            tests.append(_attribute_test(attr.lower(), op or None, value))
        elif pseudo in ("first-child", "last-child", "nth-child"):
            at = {"first-child": lambda k: 0, "last-child": lambda k: k - 1, "nth-child": lambda k, n=n: int(n or 0) - 1}[pseudo]
            tests.append(lambda e, at=at: (lambda p: p[1] == at(len(p[0])))(_place(e)))
        else:
            raise ValueError(f"unknown pseudo-class :{pseudo}")
    return lambda e: all(t(e) for t in tests)


def css(selector: str):
    """A function from a tree to the elements the selector picks, in order of the page."""
    chains = []
    for part in selector.split(","):
        tokens = re.findall(r"[>+~]|(?:[^\s>+~\[\]]|\[[^\]]*\])+", part.strip())
        chain, link = [], " "
        for t in tokens:
            if t in ">+~":
                link = t
            else:
                chain.append((link, _compound(t)))
                link = " "
        if not chain or link != " ":
            raise ValueError(f"not a selector: {selector!r}")
        chains.append(chain)

    def fits(e: Element, chain: list, at: int) -> bool:
        link, test = chain[at]
        if e.parent is None or not test(e):
            return False
        if at == 0:
            return True
        if link == ">":
            return fits(e.parent, chain, at - 1)
        if link == " ":
            up = e.parent
            while up is not None:
                if fits(up, chain, at - 1):
                    return True
                up = up.parent
            return False
        kin, i = _place(e)
        return any(fits(k, chain, at - 1) for k in (kin[i - 1 : i] if link == "+" else kin[:i]))

    return lambda root: [e for e in root.walk() if any(fits(e, c, len(c) - 1) for c in chains)]


def _predicate(text: str):
    text = text.strip()
    if text.isdigit():
        return int(text)
    if text == "last()":
        return -1
    if m := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"'](.*)[\"'])?", text):
        return _attribute_test(m[1].lower(), "=" if m[2] is not None else None, m[2] or "")
    if m := re.fullmatch(r"contains\(\s*(?:@([\w:-]+)|(?:text\(\)|\.))\s*,\s*[\"'](.*)[\"']\s*\)", text):
        return (lambda e, a=m[1].lower(), v=m[2]: v in e.attrs.get(a, "")) if m[1] else (lambda e, v=m[2]: v in e.text(" "))
    if m := re.fullmatch(r"(?:text\(\)|\.)\s*=\s*[\"'](.*)[\"']", text):
        return lambda e, v=m[1]: e.text(" ") == v
    raise ValueError(f"unknown predicate [{text}]")


def xpath(path: str):
    """A function from a tree to elements, or to strings where the last step is @attr or text()."""
    full = path if path.startswith("/") else "//" + path.removeprefix("./")
    steps = list(_STEP.finditer(full))
    if "".join(m[0] for m in steps) != full or not steps:
        raise ValueError(f"not a path: {path!r}")
    made = [(m[1], m[2], [_predicate(p) for p in re.findall(r"\[([^\]]+)\]", m[3])]) for m in steps]

    def run(root: Element) -> list:
        now: list = [root]
        for axis, name, predicates in made:
            out: list = []
            for e in now:
                if name.startswith("@") or name == "text()":
                    src = list(e.walk()) if axis == "//" else [e]
                    out += [x.attrs[name[1:].lower()] for x in src if name[1:].lower() in x.attrs] if name.startswith("@") else [c for x in src for c in x.children if isinstance(c, str)]
                    continue
                groups = [_kids(x) for x in e.walk()] if axis == "//" else [_kids(e)]
                if name in (".", ".."):
                    groups = [[e if name == "." or e.parent is None else e.parent]]
                for group in groups:
                    picked = [x for x in group if name in ("*", ".", "..") or x.tag == name.lower()]
                    for p in predicates:
                        picked = picked[p - 1 : p] if isinstance(p, int) and p > 0 else picked[-1:] if p == -1 else [x for x in picked if p(x)]
                    out += picked
            seen: set[int] = set()
            now = [x for x in out if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
        return now

    return run


def rule_values(rule: dict, root: Element | None, html: str) -> list[str]:
    if rule["type"] == "regex":
        return [m if isinstance(m, str) else "".join(m) for m in re.findall(rule["pattern"], html)]
    out = []
    for x in (css if rule["type"] == "css" else xpath)(rule["selector"])(root):
        attr = rule.get("attr", "text")
        value = x.strip() if isinstance(x, str) else x.text("", UNSEEN) if attr == "text" else x.attrs.get(attr)
        if value or (rule["type"] == "css" and value is not None):
            out.append(value)
    return out


def custom_data(pages: DataFrame, rules: list[dict], id_column: str = "url_id") -> DataFrame:
    """(id, custom_data) with a map from rule name to value; several values of a ``multiple`` rule are lines, no value is null."""
    for r in rules:
        if not r.get("name") or r.get("type") not in ("css", "xpath", "regex"):
            raise ValueError(f"not a rule: {r}")
        re.compile(r["pattern"]) if r["type"] == "regex" else (css if r["type"] == "css" else xpath)(r["selector"])
    kind, tree_needed = dict(pages.dtypes)[id_column], any(r["type"] != "regex" for r in rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = []
            for html in pdf.html.fillna(""):
                root = parse(html) if tree_needed else None
                values = {r["name"]: rule_values(r, root, html) for r in rules}
                cells.append({r["name"]: ("\n".join(v) if r.get("multiple") else v[0]) if (v := values[r["name"]]) else None for r in rules})
            yield pd.DataFrame({id_column: pdf[id_column], "custom_data": cells})

    return pages.select(id_column, "html").mapInPandas(run, f"{id_column} {kind}, custom_data map<string, string>")
