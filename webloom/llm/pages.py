"""Main body of web pages: boosted trees over nodes of the document tree, decoded from the top down.

A page is parsed once into elements and text pieces.  Features of a node are its text, its density of
links and sentences over the subtree, its tag and those above it, its depth, its siblings, where it stands
to the page's heading, how many pages say the same words, and its attribute tokens, each weighed by how
often it marks body text in the sample.  Trees are fitted on a bounded sample of pages whose older
extraction serves as noisy label.  Decoding keeps a node only if all nodes above it are kept, and keeps the set of
highest total score, so a stray piece in a side box goes with the box.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import plain_host
from webloom.llm.records import sampled
from webloom.scratch import Scratch

SAMPLE, TREES, DEPTH, BINS, RATE = 800, 60, 5, 48, 0.25
INLINE = frozenset("a b em strong span i code".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript head title template svg iframe".split())
_CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_BLOCKS = frozenset("div section article aside nav header footer main ul ol table blockquote pre h1 h2 h3 h4 h5 h6 form p".split())
_TOKEN = re.compile(r"<!--.*?-->|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT, _BLANKS, _DIGITS = re.compile(r"[^a-z]+"), re.compile(r"\s+"), re.compile(r"\d+")
TAGS = ["p", "li", "td", "h1", "h2", "div", "blockquote", "pre", "button", "ul", "table", "section", "article", "aside", "header", "footer", "nav", "main"]
ABOVE = ["article", "main", "section", "aside", "header", "footer", "nav", "table", "ul", "form"]


def clean(text: str) -> str:
    if "&" in text:
        text = entities.unescape(text)
    return " ".join(text.split()) if text.isascii() else _BLANKS.sub(" ", text).strip()


@dataclass
class Node:
    parent: int
    tag: str
    tokens: tuple[str, ...] = ()
    text: str = ""  # of a piece
    linked: int = 0  # characters inside links
    children: list[int] = field(default_factory=list)


def parse(source: str) -> list[Node]:
    """Elements and pieces in order of the page; node 0 is the root, a piece has the tag ``#``.

    Unclosed items, cells and paragraphs end where the next one begins; stray end tags are ignored; what a
    broken page leaves open ends with it.
    """
    nodes, stack, hidden = [Node(-1, "root")], [0], 0
    words: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = clean("".join(words))
        if text:
            nodes.append(Node(stack[-1], "#", text=text, linked=min(linked, len(text))))
            nodes[stack[-1]].children.append(len(nodes) - 1)
        words.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            words.append(text)
            if in_link:
                linked += len(text.strip())

    def pop_to(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            hidden -= nodes[stack.pop()].tag in HIDDEN

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link - 1) if end else 1
            continue
        if words:
            flush()
        if end:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].tag == tag), 0)
            if depth:
                pop_to(depth)
            in_link = 0
            continue
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCKS else ())
        for d in range(len(stack) - 1, 0, -1):
            open_tag = nodes[stack[d]].tag
            if open_tag in closes:
                pop_to(d)
                break
            if open_tag in _STOPS.get(tag, ()) or (tag not in _CLOSES and open_tag != "p"):
                break
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        tokens = tuple(t for a in _ATTR.findall(m[3]) for t in _SPLIT.split("".join(a).lower()) if t)
        nodes.append(Node(stack[-1], tag, tokens))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        hidden += tag in HIDDEN
        if tag in ("script", "style"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = stop.start() if stop else len(source)
    say(source[at:])
    flush()
    return nodes


def phrase(text: str) -> int:
    """Hash of a piece whatever its numbers."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", text.lower())) - (1 << 63)


def features(nodes: list[Node], common: dict[int, float], weight: dict[str, float]) -> np.ndarray:
    """One row per node; ``common``: share of pages that say a phrase; ``weight``: log-odds of attribute tokens."""
    n = len(nodes)
    chars, links, pieces, sentences, longest, depth, order = ([0] * n for _ in range(7))
    shared, tokens, has_h1 = [0.0] * n, [0.0] * n, [0] * n
    above, none = [(0,) * len(ABOVE)] * n, (0,) * len(ABOVE)
    place = {t: k for k, t in enumerate(ABOVE)}
    first_h1 = next((i for i, x in enumerate(nodes) if x.tag == "h1"), -1)
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            depth[i], above[i], tokens[i] = depth[p] + 1, above[p], tokens[p]
        if (k := place.get(x.tag)) is not None:
            here = above[i] if p >= 0 else none
            above[i] = (*here[:k], 1, *here[k + 1 :])
        if x.tokens:
            known = [weight.get(t, 0.0) for t in x.tokens]
            tokens[i] = min(tokens[i], *known) if tokens[i] < 0 else max(known, key=abs)
        if x.tag == "#":
            size = len(x.text)
            chars[i], links[i], pieces[i], longest[i] = size, x.linked, 1, size
            sentences[i] = int(x.text[-1] in ".!?…。:;" or size > 120)
            shared[i] = math.log10(1e-5 + common.get(phrase(x.text), 0.0))
    if first_h1 >= 0:
        has_h1[first_h1] = 1
    total_shared = shared.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        pieces[p] += pieces[i]
        sentences[p] += sentences[i]
        has_h1[p] += has_h1[i]
        total_shared[p] += total_shared[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
    levels = [9.0] * n  # levels up to the nearest element that holds the heading
    for i, x in enumerate(nodes):
        levels[i] = 0.0 if has_h1[i] else (levels[x.parent] + 1 if x.parent >= 0 else 9.0)
    chars, links, pieces, sentences, longest, depth, total_shared, tokens, has_h1, to_h1 = (np.array(v, dtype=float) for v in (chars, links, pieces, sentences, longest, depth, total_shared, tokens, has_h1, levels))
    above, order = np.array(above, dtype=float), np.arange(n) / n
    each = np.maximum(1, pieces)
    out = np.zeros((n, 24 + 2 * len(TAGS) + len(ABOVE)), dtype=np.float32)
    parent = np.array([max(0, x.parent) for x in nodes])
    link_share, mean, sent = links / np.maximum(1, chars), chars / each, sentences / each
    is_piece = np.array([x.tag == "#" for x in nodes])
    block = np.where(is_piece, parent, np.arange(n))
    base = [
        is_piece, np.log1p(chars), link_share, sent, np.log1p(pieces), np.log1p(longest), total_shared / each, depth, order, tokens, to_h1, order - (order[first_h1] if first_h1 >= 0 else 0), np.log1p(mean),
        link_share[parent], sent[parent], np.log1p(mean[parent]), np.log1p(pieces[parent]), (total_shared / each)[parent], link_share[parent[parent]], np.log1p(pieces[parent[parent]]), (total_shared / each)[parent[parent]], has_h1[parent] > 0,
    ]
    out[:, : len(base)] = np.stack(base, 1)
    logs = np.log1p(chars)
    pairs = np.array([(a, b) for x in nodes for a, b in zip(x.children, x.children[1:])], dtype=np.int64).reshape(-1, 2)
    out[pairs[:, 1], 22], out[pairs[:, 0], 23] = logs[pairs[:, 0]], logs[pairs[:, 1]]
    code = {t: k for k, t in enumerate(TAGS)}
    kind = np.array([code.get(x.tag, -1) for x in nodes])
    for at, j in ((24, block), (24 + len(TAGS), parent[block])):
        row = np.flatnonzero(kind[j] >= 0)
        out[row, at + kind[j[row]]] = 1
    out[:, 24 + 2 * len(TAGS) :] = above
    return out


class BoostedTrees:
    """Binary log-loss boosting with histogram splits; trees are complete, so a prediction is DEPTH look-ups.

    Each tree sees half of the rows and half of the features, picked at random but repeatably.
    """

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        rng, n, m = np.random.default_rng(3), len(y), x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned, width = self._binned(x), BINS + 1
        telling = np.flatnonzero(binned.max(0) > binned.min(0)) if n else np.arange(m)
        mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.start, trees = float(np.log(mean / (1 - mean))), []
        f = np.full(n, self.start)
        for _ in range(TREES):
            used = np.flatnonzero(rng.random(n) < 0.5) if n > 1000 else np.arange(n)
            features = np.sort(rng.choice(telling, max(1, (len(telling) + 1) // 2), replace=False)) if len(telling) else np.zeros(1, dtype=np.int64)
            some = binned[used]
            p = 1 / (1 + np.exp(-f[used]))
            g, h = (p - y[used]) * w[used], p * (1 - p) * w[used]
            at = np.zeros(len(used), dtype=np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, width, dtype=np.int64)
            for level in range(DEPTH):
                first, count = 2**level - 1, 2**level
                best, choice = np.zeros(count), [(0, width)] * count
                local = (at - first) * width
                for j in features:
                    cell = local + some[:, j]
                    gs, hs = (np.bincount(cell, weights=v, minlength=count * width).reshape(count, width).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 2) | (ht - hs < 2)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    for node in np.flatnonzero(top > best + 1e-9):
                        best[node], choice[node] = top[node], (int(j), int(k[node]) + 1)
                for node, (j, c) in enumerate(choice):
                    feature[first + node], cut[first + node] = j, c
                at = 2 * at + 1 + (some[np.arange(len(used)), feature[at]] >= cut[at])
            leaf = at - (2**DEPTH - 1)
            gs, hs = (np.bincount(leaf, weights=v, minlength=2**DEPTH) for v in (g, h))
            trees.append((feature, cut, -RATE * gs / (hs + 1)))
            f += self._walk(binned, *trees[-1])
        self.trees = trees
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    @staticmethod
    def _walk(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        flat, base = binned.ravel(), np.arange(len(binned)) * binned.shape[1]
        at = np.zeros(len(binned), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (flat[base + feature[at]] >= cut[at])
        return value[at - (2**DEPTH - 1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for lo in range(0, len(x), 8192):  # a block stays in a core's cache for all trees
            binned = self._binned(x[lo : lo + 8192])
            for tree in self.trees:
                out[lo : lo + 8192] += self._walk(binned, *tree)
        return out


def decode(nodes: list[Node], logit: np.ndarray) -> list[int]:
    """Pieces of the best set of nodes that holds the parent of each of its nodes."""
    gain = [float(v) for v in logit]
    gain[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept, out = [False] * len(nodes), []
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
        if kept[i] and nodes[i].tag == "#":
            out.append(i)
    return out


class BodyModel:
    def __init__(self, weight: dict[str, float], trees: BoostedTrees | None):
        self.weight, self.trees = weight, trees

    @classmethod
    def fit(cls, pages: list[tuple[list[Node], str, dict[int, float]]]) -> BodyModel:
        """pages: (nodes, older extraction, share of each phrase on the page's host).  Without any page every piece is kept."""
        marks, seen, good = [], Counter(), Counter()
        for nodes, text, _ in pages:
            lines = {clean(x) for x in text.split("\n")}
            kept, chars = np.zeros(len(nodes)), np.zeros(len(nodes))
            for i in range(len(nodes) - 1, -1, -1):
                x = nodes[i]
                if x.tag == "#":
                    chars[i], kept[i] = len(x.text), len(x.text) * (x.text in lines)
                if i:
                    chars[x.parent] += chars[i]
                    kept[x.parent] += kept[i]
            mark = kept > 0.5 * chars
            marks.append((mark, chars > 0))
            for i, x in enumerate(nodes):
                if chars[i]:
                    for t in set(x.tokens):
                        seen[t] += 1
                        good[t] += int(mark[i])
        weight = {t: float(np.log((good[t] + 1) / (n - good[t] + 1))) for t, n in seen.items() if n >= 5}
        if not pages:
            return cls({}, None)
        x = np.concatenate([features(nodes, common, weight) for nodes, _, common in pages])
        y, used = (np.concatenate([m[k] for m in marks]) for k in (0, 1))
        return cls(weight, BoostedTrees().fit(x[used], y[used].astype(float), np.ones(int(used.sum()))))

    def bodies(self, parsed: list[list[Node]], common: list[dict[int, float]]) -> list[list[str]]:
        """Distinct pieces of the body of each page, in order."""
        if self.trees is None:
            return [list(dict.fromkeys(x.text for x in nodes if x.tag == "#")) for nodes in parsed]
        if not parsed:
            return []
        logit = self.trees.logits(np.concatenate([features(nodes, c, self.weight) for nodes, c in zip(parsed, common)]))
        ends = np.cumsum([0, *(len(nodes) for nodes in parsed)])
        return [list(dict.fromkeys(nodes[i].text for i in decode(nodes, logit[a:b]))) for nodes, a, b in zip(parsed, ends, ends[1:])]


def packed(nodes: list[Node]) -> bytes:
    return pickle.dumps([(x.parent, x.tag, x.tokens, x.text, x.linked) for x in nodes], protocol=5)


def unpacked(blob: bytes) -> list[Node]:
    nodes = [Node(*x) for x in pickle.loads(blob)]  # written by ``packed`` in this run
    for i in range(1, len(nodes)):
        nodes[nodes[i].parent].children.append(i)
    return nodes


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(id, host, blob, phrases) of pages (id, host, html): the tree, and the hashes of its phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees = [parse(h) for h in pdf.html]
            yield pd.DataFrame({"id": pdf.id, "host": pdf.host, "blob": [packed(t) for t in trees], "phrases": [sorted({phrase(x.text) for x in t if x.tag == "#"}) for t in trees]})

    return pages.select("id", "host", "html").mapInPandas(run, "id long, host string, blob binary, phrases array<bigint>")


def phrase_shares(held: DataFrame, least: int = 4) -> DataFrame:
    """(id, phrases, shares): the phrases of each page that at least ``least`` pages of its host hold, with their share of its pages.

    held: ``parsed_pages``, of which only hashes move.  A host's pages are counted by pre-aggregated sums; pages sent twice count twice.
    """
    sizes = held.groupBy("host").agg(F.count("*").alias("pages"))
    each = held.select("id", "host", F.explode("phrases").alias("phrase"))
    common = each.groupBy("host", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(sizes, "host").select("host", "phrase", (F.col("n") / F.col("pages")).alias("share"))
    return each.join(common, ["host", "phrase"]).groupBy("id").agg(F.collect_list("phrase").alias("phrases"), F.collect_list("share").alias("shares"))


def page_bodies(pages: DataFrame, extractions: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, field_name, piece) of the main body: distinct pieces of html, and the lines of main_text that are among them.

    pages: id, url, html; extractions: id, main_text, confidence.  Trees learn from extractions of ``high`` confidence, or
    from all where there are none.  Each page is parsed once.  Of several rows of a page each counts, equal pieces once; null or
    empty html has no body, and then, as without a page, a main_text keeps all its lines.  Without any extraction to learn from
    all pieces are kept.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    held = scratch.cut(parsed_pages(pages.where("id is not null and html <> ''").select("id", F.coalesce(plain_host(F.col("url")), F.lit("")).alias("host"), "html")), "parsed")
    texts = extractions.where("id is not null and trim(main_text) <> ''").select("id", "main_text").distinct()
    shares = scratch.cut(phrase_shares(held), "shares")
    whole = held.select("id", "blob").join(shares, "id", "left").join(texts, "id", "full_outer")
    trusted = extractions.where("id is not null and trim(main_text) <> '' and confidence = 'high'").select("id", "main_text")
    if not trusted.limit(1).count():
        trusted = texts
    one = trusted.groupBy("id").agg(F.min("main_text").alias("main_text"))  # of several rows of a page one will do to learn from
    chosen = sampled(held.select("id").join(one.select("id"), "id", "left_semi"), sample, "id")
    first = held.select("id", "blob").join(chosen, "id", "left_semi").groupBy("id").agg(F.min("blob").alias("blob"))
    learn = first.join(shares, "id", "left").join(one, "id").collect()
    model = BodyModel.fit([(unpacked(r.blob), r.main_text, dict(zip(r.phrases or [], r.shares or []))) for r in learn])
    shared = spark.sparkContext.broadcast(model)  # a fixed number of trees, and tokens of the sample

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                known = [dict(zip(p, s)) if p is not None else {} for p, s in zip(part.phrases, part.shares)]
                trees = [unpacked(b) if b is not None else [Node(-1, "root")] for b in part.blob]
                rows = []
                for i, blob, text, body in zip(part.id.tolist(), part.blob, part.main_text, shared.value.bodies(trees, known)):
                    rows += [(i, "html", x) for x in body]
                    if text is not None:
                        inside = set(body)
                        rows += [(i, "main_text", x) for x in dict.fromkeys(clean(y) for y in text.split("\n")) if x and (x in inside or blob is None)]
                yield pd.DataFrame(rows, columns=["id", "field_name", "piece"])

    return scratch.cut(whole.select("id", "blob", "phrases", "shares", "main_text").mapInPandas(bodies, "id long, field_name string, piece string"), "bodies").distinct()
