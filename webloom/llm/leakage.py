"""Evaluation texts inside a training corpus, found with suffix arrays of the training shards.

A shard is a bounded number of characters of an Arrow batch of documents.  Its words become numbers of the evaluation
vocabulary (0 for all other words), and its suffixes that begin with known words are sorted as a whole.  Every suffix
of every evaluation item is binary-searched in them, one word deeper at a time: the nested intervals give each place's longest
verbatim match.  Documents that share no words with an item that hardly any other item holds are dropped at once; of the others all
matches are listed, and those of one document and item that lie on nearly one line are chained over misspelt, dropped or
replaced words.  Chains that may matter are aligned word by word, many at once.  Words count by how few items hold them, so that the
names and figures of an item weigh and the wording that many items share does not.  A passage must hold
two words, and most of the words, that hardly any other item has: a text of the same wording about other
things does not.

The evaluation side is bounded (``most_words``, counted before it is collected) and goes to all tasks; documents are never
shuffled, and no state outlives a shard.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, WORDS, SHARE, GAP, RARE, MOST_WORDS, SHARD = 3, 15, 0.78, 3, 0.01, 2_000_000, 16_000_000
_MARKS = re.compile(r"[\u0300-\u036f\u3099\u309a]+")
_TAG = re.compile(r"<[^<>\n]{0,200}>|&[a-z]{2,6};|&#\d{1,6};")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words without markup, accents or punctuation; a word broken by a soft hyphen is one."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("­", "").replace("​", ""))
        text = _MARKS.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.casefold())


@functools.lru_cache(200_000)
def alike(a: str, b: str) -> bool:
    """Equal, or letters only and one slip apart (two in words of eight letters or more)."""
    if a == b:
        return True
    if len(a) < 3 or len(b) < 3 or abs(len(a) - len(b)) > 2 or any(c.isdigit() for c in a + b):
        return False
    most = 2 if min(len(a), len(b)) >= 8 else 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


@functools.lru_cache(200_000)
def _letters(word: str) -> tuple[int, int]:
    """Which letters a word has, as bits, and its length; a slip changes two bits at most."""
    return functools.reduce(lambda m, c: m | 1 << (ord(c) & 63), word, 0), len(word)


class Items:
    """Vocabulary, weights and sorted suffixes of the evaluation items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words = ids, [words_of(t) for t in texts]
        held = Counter(w for ws in self.words for w in set(ws))
        self.number = {w: n for n, w in enumerate(sorted(held), 1)}
        self.weight = {w: 0.1 + math.log((len(ids) + 1) / n) for w, n in held.items()}
        self.rare = {w for w, n in held.items() if n <= max(2, RARE * len(ids))}
        self.flat = np.array([x for ws in self.words for x in [*(self.number[w] for w in ws), 0]] or [0], dtype=np.int64)
        self.item = np.repeat(np.arange(len(ids)), [len(ws) + 1 for ws in self.words]) if ids else np.zeros(1, dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in self.words])])
        self.flat_weight = np.array([x for ws in self.words for x in [*(self.weight[w] for w in ws), 0.0]] or [0.0])
        self.flat_rare = np.array([x for ws in self.words for x in [*(w in self.rare for w in ws), False]] or [False])
        self.suffixes = np.flatnonzero(self.flat)


def suffix_array(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places ``begin`` in the order of what follows them, up to the first 0; equal suffixes in the order given.

    Several words make one digit of a radix sort; only suffixes that are still equal are looked at further.
    """
    bits = int(ids.max(initial=1)).bit_length()
    width = max(1, 63 // bits)
    padded = np.concatenate([ids, np.zeros(width, dtype=np.int64)])

    def digit(at: np.ndarray) -> np.ndarray:
        key, live = np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool)
        for k in range(width):
            word = padded[np.minimum(at + k, len(padded) - 1)]
            live &= word > 0
            key = (key << bits) | np.where(live, word, 0)
        return key

    array, slots, depth = begin.copy(), np.arange(len(begin)), 0
    group = np.zeros(len(begin), dtype=np.int64)
    last = (1 << bits) - 1
    while len(slots):
        key = digit(array[slots] + depth)
        order = np.lexsort((key, group[slots]))
        array[slots], key = array[slots][order], key[order]
        old = group[slots]  # slots of a group are neighbours and stay so
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
        group[slots] = first = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        twin = np.concatenate([first[1:] == first[:-1], [False]])
        twin[1:] |= first[1:] == first[:-1]
        slots = slots[twin & (key & last > 0)]  # a digit that ends in 0 has met the end
        depth += width
    return array


def _bound(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, array: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Per query, where ``word`` would go among the words ``depth`` after the places array[lo:hi], which are in order."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        found = words[np.minimum(array[mid] + depth, len(words) - 1)]
        below = found <= word[live] if right else found < word[live]
        lo[live[below]], hi[live[~below]] = mid[below] + 1, mid[~below]
        live = live[lo[live] < hi[live]]
    return lo


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())


def longest_matches(items: Items, ids: np.ndarray, telling: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, place in the items, words) of all verbatim matches of SEED words that can't be longer to either side.

    With ``telling`` only those that hold a word hardly any other item has; others are never listed then.
    """
    words = np.append(ids, 0)
    known = ids > 0
    for k in range(1, SEED):
        known[:-k] &= ids[k:] > 0
        known[-k:] = False
    array = suffix_array(words, np.flatnonzero(known))
    q = items.suffixes
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(array), dtype=np.int64)
    flat, rares, out = np.append(items.flat, 0), np.concatenate([[0], np.cumsum(items.flat_rare)]), []
    depth = 0
    while len(q):
        if depth >= SEED:  # matches that end here: in the interval, but not in the next one
            new_lo, new_hi = lo.copy(), lo.copy()
            go = np.flatnonzero(flat[q + depth] > 0)
            new_lo[go] = _bound(words, lo[go], hi[go], flat[q[go] + depth], array, depth, False)
            new_hi[go] = _bound(words, new_lo[go], hi[go], flat[q[go] + depth], array, depth, True)
            say = np.ones(len(q), dtype=bool) if not telling else rares[q + depth] > rares[q]
            for a, b in ((lo, new_lo), (new_hi, hi)):
                n = np.where(say, b - a, 0)
                out.append((array[_spread(a, n)], np.repeat(q, n), np.full(int(n.sum()), depth)))
        else:
            word = flat[q + depth]
            new_lo = _bound(words, lo, hi, word, array, depth, False)
            new_hi = np.where(word > 0, _bound(words, new_lo, hi, word, array, depth, True), new_lo)
        left = new_hi > new_lo
        q, lo, hi, depth = q[left], new_lo[left], new_hi[left], depth + 1
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    p, q, size = (np.concatenate([x[k] for x in out]) for k in range(3))
    keep = ~((p > 0) & (q > 0) & (ids[p - 1] == items.flat[q - 1]) & (ids[p - 1] > 0))
    return p[keep], q[keep], size[keep]


def aligned(pairs: list[tuple[list[str], list[str]]], items: Items) -> list[tuple[int, float, int, int, int, int, int]]:
    """Best local alignment of each (words of a document, words of an item), all at once.

    (words of the item spanned, the lesser share of words or their weight that matched, rare words matched and
    spanned, last word of the document's passage, first and last of the item's).
    """
    n, rows, cols = len(pairs), max(len(d) for d, _ in pairs), max(len(t) for _, t in pairs)
    hit, weight, rare = np.zeros((n, rows, cols), dtype=bool), np.zeros((n, cols)), np.zeros((n, cols), dtype=bool)
    for k, (doc, item) in enumerate(pairs):
        weight[k, : len(item)] = [items.weight[w] for w in item]
        rare[k, : len(item)] = [w in items.rare for w in item]
        (a, la), (b, lb) = (np.array([_letters(w) for w in ws], dtype=np.uint64).T for ws in (doc, item))
        near = (np.bitwise_count(a[:, None] ^ b[None, :]) <= 4) & (np.abs(la[:, None].astype(int) - lb[None, :].astype(int)) <= 2)
        for i, j in zip(*np.nonzero(near)):
            hit[k, i, j] = alike(doc[i], item[j])
    # score, first word of the item, weight, words and rare words matched, first word of the document
    zero = np.zeros((6, n))
    best, end, last = zero.copy(), np.zeros((2, n)), [zero] * (cols + 1)
    for i in range(rows):
        row = [zero]
        for j in range(cols):
            c, h = weight[:, j], hit[:, i, j]
            here = last[j].copy()
            fresh = here[0] <= 0
            here[:, fresh] = 0.0
            here[1, fresh], here[5, fresh] = j, i
            here[0] += np.where(h, c, -c - 0.3)
            here[2] += np.where(h, c, 0.0)
            here[3] += h
            here[4] += h & rare[:, j]
            for other, cost in ((last[j + 1], 1.0), (row[j], c + 0.3)):
                better = other[0] - cost > here[0]
                if better.any():
                    here = np.where(better, other, here)
                    here[0] -= np.where(better, cost, 0.0)
            here = np.where((here[0] > 0) & (c > 0), here, 0.0)
            row.append(here)
            top = h & (here[0] > best[0])
            if top.any():
                best, end = np.where(top, here, best), np.where(top, np.array([[j + 1.0], [i + 1.0]]), end)
        last = row
    out = []
    for k, (_, item) in enumerate(pairs):
        first, stop = int(best[1, k]), int(end[0, k])
        spanned, total = stop - first, float(weight[k, first:stop].sum())
        share = min(best[2, k] / max(1e-9, total), best[3, k] / max(1, spanned))
        out.append((spanned, float(share), int(best[4, k]), int(rare[k, first:stop].sum()), int(best[5, k]), int(end[1, k]), first))
    return out


def _chains(at: list[int], places: list[int], size: list[int], gain: list[float], n_rare: list[int]) -> list[list[float]]:
    """Matches of one document and item joined where each ends within GAP words of the next start on both sides."""
    chains: list[list[float]] = []
    ends: dict[int, list[int]] = {}  # place in the shard -> chains that end there
    for a, b, n, g, r in zip(at, places, size, gain, n_rare):
        last = -1
        for e in range(a - GAP, a + n):
            if e in ends:
                ends[e] = [x for x in ends[e] if b - chains[x][3] <= GAP]  # matches come by place in the item
                last = max(last, *(x for x in ends[e] if -n < b - chains[x][3]), -1)
        if last < 0:
            chains.append([a, b, a + n, b + n, g, r])
            ends.setdefault(a + n, []).append(len(chains) - 1)
            continue
        c = chains[last]
        if a + n > c[2]:
            ends[c[2]].remove(last)
            ends.setdefault(a + n, []).append(last)
        c[2], c[3], c[4] = max(c[2], a + n), max(c[3], b + n), c[4] + g
        c[5] += r
    return chains


def search_shard(items: Items, docs: list[list[str]], words: int, share: float) -> list[tuple[int, int, int, int, float, int, int, int]]:
    """(document, item, words spanned, longest verbatim match, matched share, first and end word in the document, first in the item) of each leak."""
    sizes = np.array([len(d) + SEED for d in docs])
    start = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(start[-1]), dtype=np.int64)
    for at, d in zip(start.tolist(), docs):
        ids[at : at + len(d)] = list(map(items.number.get, d, itertools.repeat(0)))
    p, q, _ = longest_matches(items, ids, telling=True)
    if not len(p):
        return []
    doc, item = np.searchsorted(start, p, "right") - 1, items.item[q]
    wanted = np.unique(doc * len(items.ids) + item)
    # all matches of the documents and items that share a telling one
    some = np.zeros(len(docs), dtype=bool)
    some[doc] = True
    p, q, size = longest_matches(items, np.where(np.repeat(some, sizes), ids, 0))
    doc, item = np.searchsorted(start, p, "right") - 1, items.item[q]
    keep = np.isin(doc * len(items.ids) + item, wanted)
    p, q, size, doc, item = (x[keep] for x in (p, q, size, doc, item))
    order = np.lexsort((p, q, item, doc))
    p, q, size, doc, item = (x[order] for x in (p, q, size, doc, item))
    gained = np.concatenate([[0], np.cumsum(items.flat_weight)])
    rares = np.concatenate([[0], np.cumsum(items.flat_rare)])
    gain, n_rare = gained[q + size] - gained[q], rares[q + size] - rares[q]
    bounds = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0), True])
    ask, pairs = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        d, i = int(doc[lo]), int(item[lo])
        for c in _chains(*(x[lo:hi].tolist() for x in (p, q, size, gain, n_rare))):
            if not c[5] or c[3] - c[1] < min(words, len(items.words[i])) - 8 or c[4] < 0.4 * (gained[int(c[3])] - gained[int(c[1])]):
                continue
            ws, target = docs[d], items.words[i]
            from_doc = max(0, int(c[0] - start[d]) - 14)
            from_item = max(0, int(c[1] - items.start[i]) - 12)
            pairs.append((ws[from_doc : int(c[2] - start[d]) + 14], target[from_item : int(c[3] - items.start[i]) + 12]))
            ask.append((d, i, int(size[lo:hi].max()), from_doc, from_item))
    out: dict[tuple[int, int], tuple] = {}
    by_size = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]) * len(pairs[k][1]))
    for at in range(0, len(by_size), 256):
        some_pairs = by_size[at : at + 256]
        for k, (n, matched, had, of, first, end, in_item) in zip(some_pairs, aligned([pairs[k] for k in some_pairs], items)):
            d, i, longest, from_doc, from_item = ask[k]
            enough = n >= min(words, len(items.words[i])) and matched >= share and had >= min(2, of) and had >= 0.6 * of
            if enough and out.get((d, i), (0,))[0] < n:
                out[d, i] = (n, longest, matched, from_doc + first, from_doc + end, from_item + in_item)
    return [(d, i, *v) for (d, i), v in out.items()]


def _shards(texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first, words of each) of runs of texts of SHARD characters, or of one longer text."""
    first, docs, chars = 0, [], 0
    for n, text in enumerate(texts):
        if docs and chars + len(text) > SHARD:
            yield first, docs
            first, docs, chars = n, [], 0
        docs.append(words_of(text))
        chars += len(text)
    if docs:
        yield first, docs


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, longest, share, doc_at, doc_end, item_at) of documents that hold ``words`` connected words of an item.

    documents: doc_id, text; items: item_id, text.  Case, punctuation, markup, accents, line breaks and about one
    word in ten may differ.  Items of fewer words than ``words`` must occur whole.  Null or empty texts hold nothing and leak
    nothing; repeated documents each get their rows.  n_words: words of the item spanned; longest: the longest
    verbatim match; doc_at, doc_end, item_at: where the passage lies, in words from 0.  Items of more than ``most_words`` words
    in all are refused.
    """
    spark = documents.sparkSession
    sound = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = sound.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    if size > most_words:
        raise ValueError(f"the evaluation items hold {size} words, more than {most_words}; search them in several runs")
    known = sound.collect()
    table = Items([r.item_id for r in known], [r.text for r in known])
    shared = spark.sparkContext.broadcast(table)  # bounded above
    names = ["doc_id", "item_id", "n_words", "longest", "share", "doc_at", "doc_end", "item_at"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for pdf in batches:
            ids = pdf.doc_id.to_numpy()
            for first, docs in _shards(pdf.text.tolist()):
                found = search_shard(t, docs, words, share)
                yield pd.DataFrame([(ids[first + d], t.ids[i], *rest) for d, i, *rest in found], columns=names)

    sane = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    return sane.mapInPandas(search, "doc_id long, item_id long, n_words int, longest int, share double, doc_at int, doc_end int, item_at int")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents no leak was found in; those without an id can't be named by a leak and stay."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
