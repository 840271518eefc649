"""A page as a tree of elements and strings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "said")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.said: list[str] = []  # of the root: all strings of the page in order, comments too

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        todo: list = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                yield e
            elif e.tag not in skip:
                todo += reversed(e.children)

    def text(self, sep: str = " ", skip: frozenset[str] = frozenset()) -> str:
        return sep.join(s for s in (x.strip() for x in self.strings(skip)) if s)

    def source(self) -> str:
        """The strings directly inside, trimmed."""
        return "".join(c for c in self.children if isinstance(c, str)).strip()

    def outer(self) -> str:
        """The element as markup, attributes in order."""
        inside = "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)
        head = self.tag + "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{head}/>" if self.tag in VOID else f"<{head}>{inside}</{self.tag}>"

    def rel(self) -> list[str]:
        return (self.attrs.get("rel") or "").lower().split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)
        self.root.said.append(data)

    def handle_comment(self, data: str) -> None:
        self.root.said.append(data)


def parse(html: str) -> Element:
    """The element tree; unclosed elements end with the page, stray end tags are ignored."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def is_json(source: str) -> bool:
    try:
        json.loads(source)
    except ValueError:
        return False
    return True
