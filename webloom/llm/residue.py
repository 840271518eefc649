"""Template residue, filler and notices in place of content.

Three character n-gram models are compared: filler, notices and natural prose.  None of them is given the
wording of a site.  Filler starts from the public dummy passages and from runs of keys; notices start from the
reason phrases of HTTP, from the titles hosts give to made-up addresses, from what pages under such a title
say, and from short texts that several hosts repeat as a whole.  Prose is every text at first.  Then, for some rounds,
all texts are scored and each counts for the model it was given to, so that forms of residue which no seed holds are
learned from the texts they share words with.  All counts run over all texts.

Every character has a log-likelihood ratio of the better residue model against prose; the mean over a window
localises residue, template slots count as residue, and a record is excluded by the share of its text inside such windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ORDERS, WINDOW, SMOOTH, COVER, ROUNDS = 20, (3, 4, 5), 28, 0.1, 0.5, 2
HOSTS, SHORT = 3, 400  # a short text that so many hosts repeat as a whole is a notice to learn from
PROSE, FILLED, NOTICE = 0, 1, 2

# The public dummy passages, and what editors and runtimes put in place of content.
FILLER = [
    "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua. ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint "
    "occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, "
    "eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. nemo enim ipsam "
    "voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione "
    "voluptatem sequi nesciunt. neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci "
    "velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem. ut enim "
    "ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi "
    "consequatur? quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, "
    "vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?",
    "at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque "
    "corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa qui "
    "officia deserunt mollitia animi, id est laborum et dolorum fuga. et harum quidem rerum facilis est et expedita "
    "distinctio. nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime "
    "placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus. temporibus autem quibusdam et aut "
    "officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. "
    "itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut "
    "perferendis doloribus asperiores repellat.",
    "test test test", "blindtext", "placeholder", "sample text", "your text here", "insert text here", "todo", "tbd", "undefined", "null",
    "nan", "[object object]", "hello world!", "click edit button to change this text.", "edit or delete it, then start writing!",
]
NOTICES = [
    "page not found", "access denied", "you need to enable javascript to run this app.", "just a moment...",
    "please enable javascript and cookies to continue", "checking your browser before accessing",
]
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^\n]{0,80}?%\}|<%[^\n]{0,80}?%>|\[\[[^\[\]\n]{0,80}\]\]|[$#]\{[^{}\n]{0,80}\}"
    r"|@@[^@\n]{1,60}@@|__[A-Za-z0-9_.]{1,60}__|%[A-Za-z_][\w.]{1,60}%|%\d\$[a-z]|\{\d\}"
)
_FIGURE = re.compile(r"\d\w*+")


def public_seeds() -> tuple[list[str], list[str]]:
    """Filler and notices everyone knows: the lists above, runs of neighbouring keys, and the reason phrases of HTTP."""
    runs = [" ".join(row[i : i + k] for i in range(len(row) - k + 1)) for row in KEYS for k in (3, 4)]
    reasons = [f"{x.value} {x.phrase}. {x.description}" for x in HTTPStatus if x.value >= 400]
    return [*FILLER, *runs, *KEYS, "xxx xx xxx"], [*NOTICES, *reasons]


def plain(text: str) -> str:
    """Lower case, numbers and codes as 0, template slots as runs of one sign, blanks single."""
    if "{" in text or "%" in text or "[" in text or "@" in text or "__" in text:
        text = _SLOT.sub(lambda m: "\x01" * max(4, len(m[0])), text)
    text, out, at = text.lower(), [], 0
    for m in _FIGURE.finditer(text):
        begin = m.start()
        while begin > at and text[begin - 1].isalpha():
            begin -= 1
        out.append(text[at:begin])
        at = m.end()
    return " ".join("0".join([*out, text[at:]]).split())


def text_key(text: Column) -> Column:
    """One spelling for texts that differ in case, blanks, numbers and codes only."""
    codes = F.regexp_replace(F.lower(text), r"(?<![\p{L}])\p{L}*+\d[\p{L}\d_]*+", "0")
    return F.trim(F.regexp_replace(codes, r"[\s\x{00A0}]+", " "))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a blank, and where each begins."""
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.frombuffer((" " + " ".join(texts)).encode("utf-32-le"), dtype=np.uint32), start


def _grams(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the n-gram that ends at each character, for each order; runs over the start of a text are harmless."""
    h, out = codes.astype(np.uint32), {}
    padded = np.concatenate([np.full(max(ORDERS), 32, dtype=np.uint32), codes])
    for k in range(1, max(ORDERS)):
        h = h * np.uint32(0x01000193) ^ (padded[max(ORDERS) - k : len(padded) - k] * np.uint32(2654435761))
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[k + 1] = (mixed ^ (mixed >> np.uint32(12))) & np.uint32((1 << BITS) - 1)
    return out


CHARS = 1_000_000  # characters worked on at once


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block


def _add(cells: np.ndarray, texts: list[str]) -> None:
    """Count the n-grams of plain texts into ``cells``, a row per order."""
    for block in _blocks(texts):
        _count(cells, _grams(_codes(block)[0]))


def _count(cells: np.ndarray, grams: dict[int, np.ndarray]) -> None:
    for row, k in zip(cells, ORDERS):
        row += np.bincount(grams[k], minlength=1 << BITS).astype(np.float32)


def _seeded(notices: list[str]) -> np.ndarray:
    """Counts per kind, order and cell of the public seeds and of ``notices``."""
    cells = np.zeros((3, len(ORDERS), 1 << BITS), dtype=np.float32)
    filler, public = public_seeds()
    _add(cells[FILLED], [plain(t) for t in filler])
    _add(cells[NOTICE], [plain(t) for t in [*public, *notices]])
    return cells


UNSEEN, STEPS = -128, 20  # ratios are kept in twentieths, so that a table fits a core's cache


def _backed_off(table: dict[int, np.ndarray], grams: dict[int, np.ndarray]) -> np.ndarray:
    """The ratio of the longest n-gram that either side has seen, 0 for none."""
    longest, *shorter = sorted(grams, reverse=True)
    score = table[longest][grams[longest]]
    left = np.flatnonzero(score == UNSEEN)
    for k in shorter:
        score[left] = found = table[k][grams[k][left]]
        left = left[found == UNSEEN]
    score[left] = 0
    return score


class ResidueModel:
    """Log-likelihood ratios of filler and of notices against prose, by hashed n-gram.

    A residue model is smoothed towards prose, so that what no residue says always speaks for prose.
    """

    def __init__(self, cells: np.ndarray):
        """cells: counts per kind (prose, filler, notice), order and hashed n-gram."""
        self.tables = []
        for own in (cells[FILLED], cells[NOTICE]):
            table = {}
            for k, mine, base in zip(ORDERS, own, cells[PROSE]):
                a, b = mine / max(1, mine.sum()), np.maximum(base, 0.5) / max(100_000, base.sum())
                ratio = np.clip(np.log((a + SMOOTH * b) / ((1 + SMOOTH) * b)), -6, 6)
                table[k] = np.where((mine == 0) & (base == 0), UNSEEN, np.rint(ratio * STEPS)).astype(np.int8)
            self.tables.append(table)

    def _scored(self, texts: list[str], cells: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        codes, start = _codes(texts)
        grams, n, sums, inside = _grams(codes), len(codes), [], codes == 1
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(start))
        lo = np.maximum(np.arange(n) - WINDOW // 2, start[:-1][owner])
        hi = np.minimum(np.arange(n) + WINDOW // 2 + 1, start[1:][owner])
        for table in self.tables:
            run = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(_backed_off(table, grams), dtype=np.int32, out=run[1:])
            inside |= run[hi] > run[lo]
            sums.append(run[start[1:]] - run[start[:-1]])
        solid = codes != 32
        inside &= solid
        cover = np.add.reduceat(inside, start[:-1], dtype=np.int64) / np.maximum(1, np.add.reduceat(solid, start[:-1], dtype=np.int64))
        kinds = np.where(cover < COVER, PROSE, np.where(sums[0] >= sums[1], FILLED, NOTICE))
        if cells is not None:
            of = kinds[owner]
            for kind in np.unique(kinds):
                mine = np.flatnonzero(of == kind)
                _count(cells[kind], {k: g[mine] for k, g in grams.items()})
        return cover, kinds

    def scored(self, plain_texts: list[str], cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Share of residue and kind of each of some plain texts; their n-grams are counted into ``cells``, if given."""
        parts = [self._scored(b, cells) for b in _blocks(plain_texts)]
        none = (np.zeros(0), np.zeros(0, dtype=np.int64))
        return tuple(np.concatenate([x, *(p[i] for p in parts)]) for i, x in enumerate(none))

    def coverage(self, texts: list[str]) -> np.ndarray:
        """Share of each text's characters, blanks aside, that lie in residue."""
        return self.scored([plain(t) for t in texts])[0]


def fit(texts: list[str], notices: list[str], rounds: int = ROUNDS) -> ResidueModel:
    """A model from texts of any kind and from what notices say, in memory."""
    seeds, known = _seeded(notices), [plain(t) for t in texts]
    cells = seeds.copy()
    _add(cells[PROSE], known)
    for _ in range(rounds):
        model, cells = ResidueModel(cells), seeds.copy()
        model.scored(known, cells)
    return ResidueModel(cells)


def _tally(texts: DataFrame, model: ResidueModel | None) -> np.ndarray:
    """Counts per kind, order and cell of all texts: prose without a model, else what the model takes them for."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a fixed number of cells

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros((3, len(ORDERS), 1 << BITS), dtype=np.float32)
        for pdf in batches:
            known = [plain(t) for t in pdf.text]
            if shared.value is None:
                _add(cells[PROSE], known)
            else:
                shared.value.scored(known, cells)
        flat = cells.ravel()
        for at in range(0, len(flat), 1 << BITS):
            hit = np.flatnonzero(flat[at : at + (1 << BITS)]) + at
            yield pd.DataFrame({"cell": hit.astype(np.int32), "n": flat[hit]})

    sums = texts.select("text").mapInPandas(count, "cell int, n float").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(3 * len(ORDERS) << BITS, dtype=np.float32)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return cells.reshape(3, len(ORDERS), 1 << BITS)


def host_notices(texts: DataFrame, titles: DataFrame, hosts: int = HOSTS, short: int = SHORT) -> DataFrame:
    """(text) of notices, each once: what pages under a notice's title say, and what ``hosts`` hosts repeat as a whole.

    texts: host, title, text; titles: title.  Only texts of up to ``short`` characters are taken to learn from.
    """
    brief = texts.where((F.length("text") <= short) & (F.trim("text") != "")).select("host", "title", "text", text_key(F.col("text")).alias("key"))
    each = brief.groupBy("key", "host").agg(F.min("text").alias("text"))
    repeated = each.where("host is not null and host <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("text").alias("text")).where(F.col("n") >= hosts)
    named = titles.where("trim(title) <> ''").select(text_key(F.col("title")).alias("named")).distinct()
    under = brief.join(named, text_key(F.col("title")) == F.col("named"), "left_semi")
    both = repeated.select("key", "text").unionByName(under.select("key", "text"))
    return both.groupBy("key").agg(F.min("text").alias("text")).select("text")


def fit_on(texts: DataFrame, probe_titles: DataFrame | None = None, rounds: int = ROUNDS) -> ResidueModel:
    """A model from all texts (host, title, text) and the titles (title) hosts give to made-up addresses.

    Null and blank texts count for nothing.  Without any text the public seeds are all there is.
    """
    sound = texts.where("trim(text) <> ''")
    if probe_titles is None:
        probe_titles = texts.select("title").limit(0)
    seeds = _seeded([])
    titles = probe_titles.where("trim(title) <> ''").select(F.col("title").alias("text")).distinct()
    seeds[NOTICE] += _tally(titles.unionByName(host_notices(texts, probe_titles)), None)[PROSE]
    cells = seeds.copy()
    cells[PROSE] += _tally(sound, None)[PROSE]
    for _ in range(rounds):
        cells = seeds + _tally(sound, ResidueModel(cells))
    return ResidueModel(cells)


def notice_titles(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """Titles of answers to made-up addresses that no page with a text of some length bears; pages: title, text."""
    real = pages.where(F.size(F.split("text", r"\s+")) >= 60).select(text_key(F.col("title")).alias("key")).distinct()
    return probes.where("title is not null").select("title", text_key(F.col("title")).alias("key")).join(real, "key", "left_anti").select("title")


def residue_coverage(texts: DataFrame, model: ResidueModel) -> DataFrame:
    """(id, coverage) of each text: the share of its characters in residue.  Null and blank texts are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a fixed number of cells

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "coverage": shared.value.coverage(pdf.text.tolist())})

    return texts.where("id is not null and trim(text) <> ''").select("id", "text").mapInPandas(score, "id long, coverage double")


def residue_lines(texts: DataFrame, model: ResidueModel) -> DataFrame:
    """(id, line_no, coverage) of the lines, counted from 1, that are residue, within texts of any kind."""
    lines = texts.where("id is not null").select("id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(F.struct("id", "pos").alias("at"), "text").where("trim(text) <> ''")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cover = shared.value.coverage(pdf.text.tolist())
            out = pd.DataFrame({"id": pdf.id, "line_no": pdf.pos + 1, "coverage": cover})
            yield out[out.coverage >= COVER]

    return lines.select("at.id", "at.pos", "text").mapInPandas(score, "id long, line_no int, coverage double")
