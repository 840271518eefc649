"""Fingerprints, verdicts and signatures of texts, as Columns and aggregations."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import netloc_of
from webloom.scratch import Scratch

_WORD = re.compile(r"\w+")
TITLE_SPLITS = [" | ", " – ", " — ", " - ", "|", "–", "—"]  # fixed value: in order of priority
NEAR, TEXT_CAP, THIN_WORDS, LOW_WORDS, SHARE = 4, 1500, 88, 50, 0.30
BLOCK, CELL, SHORT = 16_384, 50_000, 64  # rows of a bucket that meet in one task, rows of buckets in one group, rows of a bucket met by shifts


def simhash64(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of each row: 64-bit fingerprints of term frequencies; texts without words get 0.

    Each word adds its count to the bits its hash sets and takes it from the others; a bit is set if its sum isn't
    negative.  A batch hashes each of its different words once; nothing is shuffled.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number: dict[str, int] = defaultdict(itertools.count().__next__)
            ids: list[int] = []
            sizes = []
            for t in pdf.text:
                words = _WORD.findall(t)
                sizes.append(len(words))
                ids.extend(map(number.__getitem__, words))
            hashes = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8] for w in number)
            bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little").astype(np.int8) * 2 - 1
            out = np.zeros(len(pdf), dtype=np.int64)
            at, ends = np.array(ids, dtype=np.int64), np.cumsum(sizes)
            for lo in range(0, len(pdf), 256):  # so many texts' words as rows of 64 at once
                hi = min(lo + 256, len(pdf))
                first = ends[lo] - sizes[lo]
                some = np.flatnonzero(np.array(sizes[lo:hi])) + lo
                if len(some):
                    sums = np.add.reduceat(bits[at[first : ends[hi - 1]]], ends[some] - np.array(sizes)[some] - first, axis=0, dtype=np.int64)
                    out[some] = np.packbits(sums >= 0, axis=1, bitorder="little").view(np.int64).ravel()
            yield pd.DataFrame({key: pdf[key], "simhash": out})

    rows = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return rows.mapInPandas(prints, f"`{key}` {dict(docs.dtypes)[key]}, simhash long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def content_verdict(sha_a: Column, sha_b: Column, distance: Column, near: int = NEAR) -> Column:
    """identical, near, changed, or unknown without a hash on one side and a distance."""
    some_null = sha_a.isNull() | sha_b.isNull()
    return F.when(some_null & distance.isNull(), "unknown").when(~some_null & (sha_a == sha_b), "identical").when(distance <= near, "near").otherwise("changed")


def _masks(most: int, agree: int) -> list[int]:
    """The bits of each choice of ``agree`` of most + agree bands."""
    bands = most + agree
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in itertools.combinations(range(bands), agree)]


def near_pairs(prints: DataFrame, fingerprint: str, most: int = NEAR, agree: int = 2) -> DataFrame:
    """(a, b, distance) of the different fingerprints at most ``most`` bits apart, a < b.

    The 64 bits fall into most + agree bands; fingerprints that near have ``agree`` equal bands, so an equi-join on
    each choice of that many bands misses none, and its keys are wide enough to keep buckets small.  Equal fingerprints
    are one, which keeps copies from pairing out; the copies are membership.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(most, agree)]
    one = prints.select(F.col(fingerprint).alias("h")).where("h is not null").distinct()
    cut = [F.struct(F.lit(i).alias("choice"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)]
    keyed = one.select("h", F.explode(F.array(*cut)).alias("k")).select("h", "k.choice", "k.bits")
    right = keyed.withColumnRenamed("h", "g")
    met = keyed.join(right, ["choice", "bits"]).where("h < g").withColumn("distance", hamming(F.col("h"), F.col("g"))).where(F.col("distance") <= most)
    return met.select(F.col("h").alias("a"), F.col("g").alias("b"), "distance").distinct()


def near_links(prints: DataFrame, fingerprint: str, most: int = NEAR, agree: int = 2, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(h, root, n): what the pairs of ``near_pairs`` come to, without writing them.

    A fingerprint has some rows, or none if nothing is near; its n add up to the number of others at most ``most``
    bits away, and (h, root) as edges have the components of all pairs.  Buckets are those of ``near_pairs``; a pair
    counts in the first choice of bands that it agrees on.  Rows of a bucket longer than ``block`` meet block by block.
    """
    masks = _masks(most, agree)
    choices = np.array(masks, dtype=np.uint64)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, node = np.unique(pdf.h.to_numpy(), return_inverse=True)
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal links, label
            if not held:
                return
            i, j = (np.concatenate(x) for x in zip(*held))
            held.clear()
            links += np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            while True:
                a, b = label[i], label[j]
                apart = a != b
                if not apart.any():
                    return
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]

        def hold(choice: int, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> None:
            """Pairs of nodes with their different bits."""
            first = np.ones(len(x), bool)
            for m in choices[:choice]:
                first &= (x & m) != 0
            held.append((i[first], j[first]))
            if sum(len(x) for x, _ in held) > 1_000_000:
                settle()

        for choice in np.unique(pdf.choice):
            of = np.flatnonzero(pdf.choice == choice)
            h, lo, hi, mine = (pdf[c].to_numpy()[of] for c in ("h", "lo", "hi", "mine"))
            bits = h.view(np.uint64) & choices[choice]
            order = np.lexsort((mine, hi, lo, bits))
            h, lo, hi, mine, bits, at = h.view(np.uint64)[order], lo[order], hi[order], mine[order], bits[order], node[of][order]
            new = np.concatenate([[True], (bits[1:] != bits[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            ends = np.append(starts[1:], len(h))
            long = ends - starts > SHORT
            short, k = np.flatnonzero(~long[run]), 0
            while len(short):
                k += 1
                short = short[short + k < ends[run[short]]]
                x = h[short] ^ h[short + k]
                near = (np.bitwise_count(x) <= most) & ((lo[short] == hi[short]) | (mine[short] != mine[short + k]))
                hold(choice, at[short[near]], at[short[near] + k], x[near])
            for s, e in zip(starts[long], ends[long]):
                one = lo[s] == hi[s]
                middle = e if one else s + np.searchsorted(mine[s:e], hi[s])
                for p in range(s, middle, 256):
                    for q in range(p if one else middle, e, 4096):
                        x = h[p : min(p + 256, middle), None] ^ h[q : min(q + 4096, e)]
                        found = np.flatnonzero(np.bitwise_count(x) <= most)
                        i, j = np.divmod(found, x.shape[1])
                        i, j, x = i + p, j + q, x.ravel()[found]
                        if one:
                            i, j, x = i[i < j], j[i < j], x[i < j]
                        hold(choice, at[i], at[j], x)
        settle()
        some = links > 0
        return pd.DataFrame({"h": nodes[some], "root": nodes[label[some]], "n": links[some]})

    one = Scratch(prints.sparkSession).cut(prints.select(F.col(fingerprint).alias("h")).where("h is not null").distinct(), "fingerprints")
    n = one.count()
    cut = [F.struct(F.lit(i).alias("choice"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)]
    keyed = one.select("h", F.explode(F.array(*cut)).alias("k")).select("h", "k.choice", "k.bits")
    if n > block:  # at most a row for every ``block`` fingerprints and choice
        large = keyed.groupBy("choice", "bits").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
        keyed = keyed.join(F.broadcast(large), ["choice", "bits"], "left")
    else:
        keyed = keyed.withColumn("blocks", F.lit(1))
    placed = keyed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    group = F.pmod(F.xxhash64("choice", "bits", "lo", "hi"), F.lit(len(masks) * n // cell + 1))
    return placed.select(group.alias("cell"), "h", "choice", "lo", "hi", "mine").groupBy("cell").applyInPandas(meet, "h long, root long, n long")


# --- titles and signatures -----------------------------------------------------------------


def title_part(title: Column, last: bool) -> Column:
    """The part before (or after the last of) the first separator, by priority, that the title has; '' for none."""
    out = F.lit("")
    for sep in reversed(TITLE_SPLITS):
        part = F.substring_index(title, sep, -1 if last else 1)
        out = F.when(title.contains(sep), F.trim(part)).otherwise(out)
    return out


def title_boilerplate(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(site, prefix, suffix): the most frequent title part of a site, where more than ``share`` of its titles have it.

    pages: url, title.  Sites with fewer than two titles are left out; ties go to the smaller text.
    """
    titles = pages.where("title is not null").select(netloc_of(F.col("url")).alias("site"), "title")
    sizes = titles.groupBy("site").agg(F.count("*").alias("titles")).where("titles >= 2")
    kinds = F.explode(F.array(F.struct(F.lit("prefix").alias("kind"), title_part(F.col("title"), False).alias("part")), F.struct(F.lit("suffix").alias("kind"), title_part(F.col("title"), True).alias("part"))))
    parts = titles.select("site", kinds.alias("k")).select("site", "k.kind", "k.part").where("part <> ''").groupBy("site", "kind", "part").agg(F.count("*").alias("n"))
    best = parts.groupBy("site", "kind").agg(F.min(F.struct(-F.col("n"), "part")).alias("best")).select("site", "kind", F.col("best.part").alias("part"), (-F.col("best.col1")).alias("n"))
    kept = best.join(sizes, "site").where(F.col("n") / F.col("titles") > share)
    return kept.groupBy("site").agg(F.max(F.when(F.col("kind") == "prefix", F.col("part"))).alias("prefix"), F.max(F.when(F.col("kind") == "suffix", F.col("part"))).alias("suffix"))


def without_boilerplate(text: Column, prefix: Column, suffix: Column) -> Column:
    """The text without a site's prefix and suffix; only one of each is taken off."""
    t = F.trim(F.coalesce(text, F.lit("")))
    ahead = t
    for sep in reversed(TITLE_SPLITS):
        ahead = F.when(t.startswith(F.concat(prefix, F.lit(sep))), F.trim(F.regexp_replace(t, F.lit("^.*?\\Q" + sep + "\\E"), F.lit("")))).otherwise(ahead)
    ahead = F.when(prefix.isNull() | (prefix == ""), t).when(t == prefix, "").otherwise(ahead)
    out = ahead
    for sep in reversed(TITLE_SPLITS):
        cut = F.substring(ahead, F.lit(1), F.length(ahead) - F.length(suffix) - len(sep))
        out = F.when(ahead.endswith(F.concat(F.lit(sep), suffix)), F.trim(cut)).otherwise(out)
    return F.when(suffix.isNull() | (suffix == ""), ahead).when(ahead == suffix, "").otherwise(out)


def signature_text(title: Column, h1: Column, description: Column, body: Column) -> Column:
    """Title, heading, description and the head of the text, those not blank, a line each."""
    parts = [F.trim(F.coalesce(x, F.lit(""))) for x in (title, h1, description)] + [F.substring(F.trim(F.coalesce(body, F.lit(""))), 1, TEXT_CAP)]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def is_thin(signature: Column, words: int = THIN_WORDS) -> Column:
    return F.when(signature.isNull(), False).otherwise(word_count(signature) < words)


def signal_confidence(words: Column, method: Column, least: int = LOW_WORDS) -> Column:
    return F.when((F.coalesce(words, F.lit(0)) < least) | (F.coalesce(method, F.lit("")) == "fallback"), "low").otherwise("high")
