"""Languages of texts and of foreign passages in them.

Every word gets a score per language: how often the language's sample holds the word, blended with a
character trigram model for words it does not hold.  The script of a word narrows the languages: those
whose sample hardly uses the script are far behind.  A Viterbi pass over the words with a penalty for
switching, lower at line breaks, labels spans; it runs over many texts at once, a word position at a time.
Scores are fitted on a bounded sample of rows whose two labels agree; a text whose label the first model
contradicts is left out of the second.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_PER_LANGUAGE, MOST_LANGUAGES, SWITCH, LINE_SWITCH, FLOOR, CHUNK, TELLING = 300, 184, 9.0, 4.0, 7.0, 256, 5.0
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def script_of(word: str) -> str:
    """Coarse script of the first letter, from its code range; kana wins over Han anywhere in the word."""
    if word.isascii():
        return "latin"
    if any("぀" <= c <= "ヿ" for c in word):
        return "kana"
    c = ord(word[0])
    for name, lo, hi in (("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("hangul", 0xAC00, 0xD7AF), ("han", 0x3400, 0x9FFF)):
        if lo <= c <= hi:
            return name
    return unicodedata.name(word[0], "other").split(" ")[0].lower()


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        words = {lang: Counter(w for t in texts[lang] for w in _WORD.findall(t.lower())) for lang in self.languages}
        self.total = np.array([max(1, sum(words[x].values())) for x in self.languages], dtype=float)
        self.words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        for i, lang in enumerate(self.languages):
            for w, n in words[lang].items():
                self.words[w][i] = n
                scripts[script_of(w)][i] += n * len(w)
                padded = f"^{w}$"
                for k in range(len(padded) - 2):
                    grams[padded[k : k + 3]][i] += 1  # types, not tokens: new words are like other words, not like "the"
        self.words, gram_total = dict(self.words), sum(grams.values()) if grams else np.ones(len(self.languages))
        self.grams = {g: np.log((n + 0.1) / (gram_total + 0.1 * (len(grams) + 1))) for g, n in grams.items()}
        self.new_gram = np.log(0.1 / (gram_total + 0.1 * (len(grams) + 1)))
        used = sum(scripts.values()) if scripts else np.ones(len(self.languages))
        self.scripts = {s: n / np.maximum(1, used) > 0.05 for s, n in scripts.items()}

    def score(self, word: str) -> np.ndarray:
        """Log score per language, 0 for the best and -FLOOR at least."""
        padded = f"^{word}$"
        spelled = sum((self.grams.get(padded[k : k + 3], self.new_gram) for k in range(min(len(padded) - 2, 20))), np.zeros(len(self.languages)))
        spelled = np.exp(np.maximum(spelled - spelled.max(), -5.0)) * 1e-5  # a new word tells less than a known one
        known = self.words.get(word)
        out = np.log(spelled + (known / self.total if known is not None else 0.0))
        allowed = self.scripts.get(script_of(word))
        if allowed is not None and allowed.any():
            out = np.where(allowed, out, out.min() - FLOOR)
        return np.maximum(out - out.max(), -FLOOR)

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[int, int]], float]]:
        """For each text: characters per language, those after a word with it, (line number, language) of each line with letters, mean margin."""
        number: dict[str, int] = {}
        split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for text in texts:
            ids, line, size = [], [], []
            for n, part in enumerate(text.lower().split("\n"), 1):
                begin = -1
                for m in _WORD.finditer(part):
                    ids.append(number.setdefault(m[0], len(number)))
                    line.append(n)
                    if begin >= 0:
                        size.append(m.start() - begin)
                    begin = m.start()
                if begin >= 0:
                    size.append(len(part) - begin)
            split.append((np.array(ids, dtype=np.int64), np.array(line, dtype=np.int64), np.array(size, dtype=np.int64)))
        scores = np.array([self.score(w) for w in number]).reshape(len(number), len(self.languages))
        order, found = sorted(range(len(texts)), key=lambda i: len(split[i][0])), {}
        for at in range(0, len(order), CHUNK):
            chunk = order[at : at + CHUNK]
            for i, path in zip(chunk, self._viterbi([split[i][:2] for i in chunk], scores)):
                found[i] = path
        return [self._summary(*split[i], found[i], scores) for i in range(len(texts))]

    def _viterbi(self, chunk: list[tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> list[np.ndarray]:
        longest, n, k = max(len(ids) for ids, _ in chunk), len(chunk), len(self.languages)
        if not longest:
            return [np.zeros(0, dtype=np.int64)] * n
        ids, breaks = np.full((longest, n), len(scores)), np.zeros((longest, n), dtype=bool)
        for j, (x, line) in enumerate(chunk):
            ids[: len(x), j] = x
            breaks[1 : len(x), j] = line[1:] != line[:-1]
        padded = np.vstack([scores, np.zeros((1, k))])
        best, back = padded[ids[0]], np.empty((longest, n, k), dtype=np.int16)
        own = np.arange(k, dtype=np.int16)
        for t in range(1, longest):
            top = best.argmax(1)
            jump = best[np.arange(n), top] - np.where(breaks[t], LINE_SWITCH, SWITCH)
            stay = best >= jump[:, None]
            back[t] = np.where(stay, own, top[:, None])
            best = np.where(stay, best, jump[:, None]) + padded[ids[t]]
        path = np.empty((longest, n), dtype=np.int64)
        path[-1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            path[t - 1] = back[t, np.arange(n), path[t]]
        return [path[: len(x), j] for j, (x, _) in enumerate(chunk)]

    def _summary(self, ids: np.ndarray, line: np.ndarray, size: np.ndarray, path: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], float]:
        k = len(self.languages)
        if not len(ids):
            return np.zeros(k), [], 0.0
        total = np.bincount(path, weights=size, minlength=k)
        numbers = np.unique(line)
        by_line = np.zeros((int(line[-1]) + 1, k))
        np.add.at(by_line, (line, path), size)
        mine = scores[ids, path]
        others = scores[ids].copy()
        others[np.arange(len(ids)), path] = -np.inf
        lead = mine - others.max(1) if k > 1 else np.full(len(ids), FLOOR)
        top = int(total.argmax())
        language = by_line.argmax(1)
        told = np.bincount(line, weights=np.where(path == language[line], lead, 0.0), minlength=len(by_line))
        # an unseen word tells less than TELLING by its spelling, so that a lone name tells no language
        return total, [(int(n), int(language[n]) if told[n] >= TELLING else top) for n in numbers], float(lead.mean())


def fit(texts: dict[str, list[str]]) -> LanguageModel:
    """A model of the languages of ``texts``; texts the first model contradicts don't count for the second."""
    model = LanguageModel(texts)
    kept = {}
    for i, lang in enumerate(model.languages):
        kept[lang] = [t for t, (total, _, _) in zip(texts[lang], model.label(texts[lang])) if total.sum() and total[i] > 0.5 * total.sum()]
    kept = {lang: ts for lang, ts in kept.items() if ts}
    return LanguageModel(kept) if kept else model


def code_of(label: Column) -> Column:
    """The part of a language label before ``-`` or ``_``, case and blanks aside; null unless two letters."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_]*)", 1)
    return F.when(code.rlike("^[a-z]{2}$") & ~code.isin("xx", "zz"), code)


def fit_on(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> LanguageModel:
    """A model from ``per_language`` texts, picked by hash, of each of the ``most`` most frequent codes; labelled: id, text, code.

    There are 184 two-letter codes of languages, so by default no language is left out but for codes that are none.
    """
    sound = labelled.where("code is not null and trim(text) <> ''")
    frequent = sound.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(most).select("code")
    sound = sound.join(F.broadcast(frequent), "code", "left_semi")  # ``most`` rows
    pick = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("id", "text")))
    rows = sound.select("id", "text", "code").withColumn("pick", pick).where(F.col("pick") <= per_language)
    texts: dict[str, list[str]] = defaultdict(list)
    for r in rows.select("code", "text").collect():
        texts[r.code].append(r.text)
    return fit(dict(texts))


def languages_of(texts: DataFrame, model: LanguageModel, skip=None) -> DataFrame:
    """(id, line_no, lang, confidence): line_no 0 for the text, and each line in another language than the text's.

    A text's language is that of most of its characters; confidence is their share, lessened where words hardly tell
    languages apart.  A line counts as foreign if its words tell its language from all others by TELLING, however short it is.  Texts without letters, null or blank ones have no row, a model without languages gives none; ``skip``, if given, maps a list of texts
    to flags of those to leave out.
    """
    if not model.languages:
        return texts.sparkSession.createDataFrame([], "id long, line_no int, lang string, confidence double")
    context = texts.sparkSession.sparkContext
    shared, flags = context.broadcast(model), context.broadcast(skip)  # both of bounded size

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, names = shared.value, np.array(shared.value.languages, dtype=object)
        for pdf in batches:
            if flags.value is not None:
                pdf = pdf[~np.asarray(flags.value(pdf.text.tolist()), dtype=bool)]
            rows = []
            for i, (total, lines, margin) in zip(pdf.id.tolist(), m.label(pdf.text.tolist())):
                if not total.sum():
                    continue
                top = int(total.argmax())
                rows.append((i, 0, names[top], float(total[top] / total.sum() * (1 - np.exp(-max(0.0, margin))))))
                rows += [(i, n, names[x], 1.0 - float(np.exp(-max(0.0, margin)))) for n, x in lines if x != top]
            yield pd.DataFrame(rows, columns=["id", "line_no", "lang", "confidence"])

    return texts.where("id is not null and trim(text) <> ''").select("id", "text").mapInPandas(label, "id long, line_no int, lang string, confidence double")
