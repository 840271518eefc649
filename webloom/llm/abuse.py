"""Abusive, hateful and sexually explicit text, by weak supervision.

Voters are lists of common words and simple syntax over classes of words (an insult near a second person, a
dehumanising word near a plural, ...); none quotes a sentence.  Disguises (figures for vowels, stars, spaced or
repeated letters) are undone word by word first.  What is known of a sentence from outside it, namely whether voters
fire elsewhere in its document and what reviewers said of the document, is one more voter.

A generative label model per category infers from the firing patterns of the sentences of all documents, trusting no voter
and no reviewer, how often each pattern occurs on true and on other sentences; voters that agree beyond what the
label explains vote as one, by their joint pattern.  Its posteriors train a linear classifier over voters, words and word pairs on a
bounded sample: a sentence counts by the marginal likelihood of its outside evidence, so wording that no voter knows is learned
where it keeps bad company, and harmless wording around a listed word is unlearned where it doesn't.  A document's score is that
of its worst sentence.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.mixing import plain_source
from webloom.llm.records import sampled

CATEGORIES, BITS, LIMIT = ("abuse", "hate", "sexual"), 18, 0.5
SAMPLE, CALM_SENTENCES = 12_000, 20_000  # documents, and sentences without evidence, that the classifier learns from
STEPS, SHRINK, FEATURES = 120, 8.0, 30  # rounds of its descent, doubt each weight meets, features that count in full

# Classes of common words.
CLASSES = {
    "insult": "moron idiot imbecile cretin dimwit halfwit dumbass asshole arsehole bastard scumbag lowlife loser parasite pig swine bitch "
    "jerk prick twat wanker dickhead douchebag retard creep clown scum maggot vermin leech coward fool dunce simpleton buffoon nitwit "
    "shithead cunt slut whore rat snake worm "
    "idiota imbecil estupido cerdo basura payaso inutil gilipollas cabron connard salaud abruti cretin ordure enfoire rate salope "
    "arschloch trottel depp vollidiot schwachkopf versager drecksack dummkopf hurensohn stronzo coglione cretino klootzak sukkel "
    "kretyn debil javel",
    "slight": "stupid pathetic worthless useless disgusting miserable filthy ugly dumb brainless spineless lazy fat total complete utter "
    "absolute fucking bloody damn goddamn such real little thick dirty",
    "you": "you your yours yourself u ur toi vous es du dich dir dein deine ihr eres sois te ti tuo sei jij je",
    "dismiss": "shut piss ferme gueule klappe callate largate vaffanculo fuck screw lost",
    "harm": "kill die dies dead burn burns beat beats smash break hang shoot rot choke hurt stab strangle suffer",
    "loathe": "hate despise loathe sick ashamed shame disgust asco",
    "beast": "vermin filth rats rat lice cockroaches cockroach parasites subhuman subhumans scum plague pest pests maggots disease savages "
    "animals apes dogs pigs plaga ratas cucarachas vermine cafards racaille ungeziefer abschaum pack gesindel brut feccia",
    "plural": "they them their these those all every everyone are multiply sind alle die gehoren son todos los las sont les tous sono tutti",
    "expel": "deport deported expel exterminate eradicate cleanse driven drive drove lock locked smashed smash burned burn hang hanged throw "
    "gas shot fuera dehors raus weggesperrt vertrieben",
    "kind": "human humans people person civilised equal",
    "deny": "not never no nothing isnt arent nicht pas",
    "slander": "breed breeding multiply theft steal stealing thieves lying liars crime criminals stink stinks blood trust",
    "explicit": "porn porno xxx nude nudes naked horny escort escorts orgasm orgasms erection erections hardcore fuck fucked fucking cock "
    "pussy cum blowjob anal milf sex sexo sexe sesso sexy uncensored unzensiert nackte nackt desnudas desnuda nues geil explicit",
    "body": "breasts breast tits nipples thighs thigh ass naughty moan moaned moaning straddled webcam strip stripped bare wet lips tongue bed "
    "dirty oral intimate lust desire undressed dressed",
    "offer": "free tonight meet call live cam cheap watch adults girls boys singles amateurs leaked pics clips videos hour show pills vivo "
    "direct censura",
    "mention": "word words term terms phrase phrases quote quoted reported report reports policy rule rules moderator moderators moderation "
    "filter filters banned removed education health museum history survey statistics said called",
    "self": "i me my myself mine",
}
_CLASS = {name: 1 << k for k, name in enumerate(CLASSES)}
_OF: dict[str, int] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _OF[_w] = _OF.get(_w, 0) | _CLASS[_name]
#: name, category ("" speaks of all), classes: all must occur, the last within so many words of the first (0: anywhere)
VOTERS = [
    ("insult near you", "abuse", ("insult", "you"), 6),
    ("slighted insult", "abuse", ("slight", "insult"), 2),
    ("insult", "abuse", ("insult",), 0),
    ("slight near you", "abuse", ("slight", "you"), 3),
    ("harm near you", "abuse", ("harm", "you"), 5),
    ("dismissal", "abuse", ("dismiss",), 0),
    ("dismissal near you", "abuse", ("dismiss", "you"), 5),
    ("loathing near you", "abuse", ("loathe", "you"), 3),
    ("beasts near plural", "hate", ("beast", "plural"), 5),
    ("beasts", "hate", ("beast",), 0),
    ("expelled plural", "hate", ("expel", "plural"), 7),
    ("not human", "hate", ("deny", "kind"), 3),
    ("slander of plural", "hate", ("slander", "plural"), 8),
    ("slander", "hate", ("slander",), 0),
    ("explicit", "sexual", ("explicit",), 0),
    ("explicit and body", "sexual", ("explicit", "body"), 10),
    ("body", "sexual", ("body",), 0),
    ("explicit offer", "sexual", ("explicit", "offer"), 8),
    ("body offer", "sexual", ("body", "offer"), 8),
    ("mention", "", ("mention",), 0),
    ("insult near myself", "", ("insult", "self"), 4),
]
#: what is known of a sentence from outside it, per category: voters elsewhere in the document x what reviewers said
OUTSIDE = 6
_VOWELS = str.maketrans("aeiou", "00000")
_PLAIN = sorted(w for w in _OF if len(w) > 2)
_MASKS = {w.translate(_VOWELS): w for w in reversed(_PLAIN)}
_STARS = {(w[0], w[-1], len(w)): w for w in reversed(_PLAIN)}
_SPACED, _HINT, _LONG = re.compile(r"(?<!\w)(?:\w ){3,}\w(?!\w)"), re.compile(r" \w \w \w(?!\w)"), re.compile(r"(\w)\1{2,}")
_MARKS = re.compile(r"[\u0300-\u036f\u3099\u309a]+")
_TOKEN = re.compile(r"[\w@$*]+(?:![\w@$*]+)*|[.!?…]+(?=\s|$)|\n|[。！？]")  # words and ends of sentences
_END = frozenset(".!?…\n。！？")


def restored(token: str) -> str:
    """A word of the lists behind figures, stars or repeats; other tokens as they are, without stars."""
    if token in _OF or token.isalpha() and not (len(token) > 3 and _LONG.search(token)):
        return token
    token = _LONG.sub(r"\1", token)
    if token in _OF or token.isdigit():
        return "0" if token.isdigit() else token
    if "*" in token and token.strip("*") and token[0].isalpha():
        return _STARS.get((token[0], token[-1], len(token)), token.replace("*", ""))
    low = token.replace("@", "0").replace("$", "s").replace("4", "0").replace("3", "0").replace("1", "0").replace("!", "0")
    return _MASKS.get(low.translate(_VOWELS), token.strip("!"))


def _joined(m: re.Match) -> str:
    x = m[0].replace(" ", "")
    return f"{x[0]} {x[1:]}" if x[0] in "ai" and x not in _OF and x[1:] in _OF else x  # an article before it


def tokens(text: str) -> list[str]:
    """Words, lower case without accents, disguises kept, and what ends sentences."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("’", "")
    text = text.replace("'", "")
    return _TOKEN.findall(_SPACED.sub(_joined, text) if _HINT.search(text) else text)


def _hash(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


class Batch:
    """Sentences of some texts as arrays: word hashes, classes, where sentences start and whose they are, votes."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        ids, size = [], np.zeros(len(texts), dtype=np.int64)
        for n, text in enumerate(texts):
            if text:
                found = tokens(text)
                ids.extend(map(number.__getitem__, found))
                size[n] = len(found)
        at, of = np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), size)
        end = np.array([w[0] in _END for w in number], dtype=bool)[at] if ids else np.zeros(0, dtype=bool)
        new = np.concatenate([[True], end[:-1] | (of[1:] != of[:-1])]) if ids else end
        words, sentence = [w if w[0] in _END else restored(w) for w in number], np.cumsum(new)[~end]
        at, of = at[~end], of[~end]
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(at) else at
        self.n, self.owner, self.start = len(texts), of[first], np.append(first, len(at))
        self.hashes = np.array([_hash(w) for w in words], dtype=np.uint64)[at] if ids else np.zeros(0, dtype=np.uint64)
        self.classes = np.array([_OF.get(w, 0) for w in words], dtype=np.int64)[at] if ids else np.zeros(0, dtype=np.int64)
        self.votes = self._votes()

    def _votes(self) -> np.ndarray:
        """One column per voter: whether it fires on the sentence."""
        out = np.zeros((len(self.owner), len(VOTERS)), dtype=bool)
        hit = np.flatnonzero(self.classes)
        if not len(hit):
            return out
        of = np.searchsorted(self.start, hit, "right") - 1
        cls = self.classes[hit]
        for k, (_, _, names, reach) in enumerate(VOTERS):
            a = np.flatnonzero(cls & _CLASS[names[0]])
            if len(names) == 1:
                out[of[a], k] = True
                continue
            b = np.flatnonzero(cls & _CLASS[names[1]])
            if not len(a) or not len(b):
                continue
            for step in (-1, 0):  # the nearest of the second class before and after, another word in the same sentence
                j = np.searchsorted(hit[b], hit[a], "left" if step else "right") + step
                ok = (j >= 0) & (j < len(b))
                x, y = a[ok], b[j[ok]]
                ok = (of[x] == of[y]) & (np.abs(hit[x] - hit[y]) <= reach)
                out[of[x[ok]], k] = True
        return out

    def features(self, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, column) of hashed words and word pairs, and a scale per sentence; pairs reach over one word too.

        ``used`` selects sentences, which are then numbered anew.  The scale keeps a long sentence from outweighing a short one.
        """
        mask, n, hashes = np.uint64((1 << BITS) - 1), len(self.owner), self.hashes
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        if used is not None:
            kept = used[of]
            of, hashes, n = (np.cumsum(used, dtype=np.int32) - 1)[of[kept]], hashes[kept], int(used.sum())
        rows, cols = [of], [((hashes ^ (hashes >> np.uint64(31))) & mask).astype(np.int32)]
        for gap in (1, 2):
            same = of[gap:] == of[:-gap]
            pair = hashes[gap:][same] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[:-gap][same] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap))
            rows.append(of[gap:][same])
            cols.append(((pair >> np.uint64(20)) & mask).astype(np.int32))
        row = np.concatenate(rows)
        size = np.bincount(row, minlength=n)
        return row, np.concatenate(cols), np.sqrt(np.minimum(1.0, FEATURES / np.maximum(1, size)))

    def outside(self, labels: list[int], strong: np.ndarray) -> np.ndarray:
        """Per sentence and category, 0 to 5: strong votes in other sentences (+3), reviewers silent (0), for (1) or against (2) it.

        labels: per text a code, two bits a category; strong: which patterns count, per sentence and category.
        """
        total = np.zeros((self.n, len(CATEGORIES)), dtype=np.int64)
        np.add.at(total, self.owner, strong.astype(np.int64))
        elsewhere = total[self.owner] - strong > 0
        code = np.array(labels, dtype=np.int64)[self.owner] if len(self.owner) else np.zeros(0, dtype=np.int64)
        said = np.stack([(code >> 2 * k) & 3 for k in range(len(CATEGORIES))], 1)
        return 3 * elsewhere + said


def _voters_of(category: str) -> list[int]:
    return [k for k, (_, cat, _, _) in enumerate(VOTERS) if cat in (category, "")]


_ONES = np.array([[cat == c for c in CATEGORIES] for _, cat, _, _ in VOTERS])


def strong_votes(votes: np.ndarray) -> np.ndarray:
    """Per sentence and category: two of its voters fire at once, and none that speaks of mentions."""
    calm = votes[:, [k for k, (_, cat, _, _) in enumerate(VOTERS) if not cat]].any(1)
    return (votes.astype(np.int64) @ _ONES >= 2) & ~calm[:, None]


class LabelModel:
    """P(joint pattern of each group of voters | sentence of the category) and P(... | other), by expectation-maximisation.

    Columns are voters (0 or 1) and at the end the outside evidence (0 to 5).  Voters that correlate beyond what the
    label explains form a group, whose joint patterns are counted; groups are independent given the label.
    """

    def __init__(self, patterns: np.ndarray, times: np.ndarray, speaks: np.ndarray, rounds: int = 200):
        """patterns: one row per pattern; speaks: 1 for a voter of the category, 0 for others; the last column is outside evidence."""
        k, n = patterns.shape[1] - 1, times.sum()
        # first guess: how many voters of the category fire, against those of mentions; the data take over from there
        score = patterns[:, :k] @ np.where(speaks, 2.0, -2.0) + np.where(patterns[:, k] % 3 == 1, 2.0, 0.0) - np.where(patterns[:, k] % 3 == 2, 1.0, 0.0) - 5.0
        p = 1 / (1 + np.exp(-score)) * (patterns[:, :k] @ speaks > 0)
        self.groups = [[i] for i in range(k + 1)]
        for r in range(rounds):
            if r == 10:
                self.groups = self._correlated(patterns, p * times, times) + [[k]]
            self._estimate(patterns, times, p)
            p = self.posterior(patterns)
        self.n = n

    @staticmethod
    def _correlated(x: np.ndarray, on: np.ndarray, times: np.ndarray) -> list[list[int]]:
        """Voters in groups that correlate within either side of the label."""
        k = x.shape[1] - 1
        close = np.zeros((k, k), dtype=bool)
        for w in (on, times - on):
            w = w / max(1e-9, w.sum())
            centred = (x[:, :k] - w @ x[:, :k]) * np.sqrt(w)[:, None]
            cov = centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            close |= np.abs(cov / sd[:, None] / sd[None, :]) > 0.1
        groups, left = [], set(range(k))
        while left:
            group, todo = set(), {min(left)}
            while todo:
                group |= todo
                todo = {j for i in todo for j in np.flatnonzero(close[i]) if j in left} - group
            left -= group
            groups.append(sorted(int(g) for g in group))
        return groups

    def _codes(self, x: np.ndarray) -> list[np.ndarray]:
        return [(x[:, g] * (OUTSIDE ** np.arange(len(g)) if g[-1] == x.shape[1] - 1 else 2 ** np.arange(len(g)))).sum(1) for g in self.groups]

    def _estimate(self, x: np.ndarray, times: np.ndarray, p: np.ndarray) -> None:
        on, off = p * times, (1 - p) * times
        self.prior = float(np.clip((on.sum() + 1) / (times.sum() + 1000), 1e-5, 0.3))
        self.ratio = []
        for g, code in zip(self.groups, self._codes(x)):
            size = OUTSIDE if g[-1] == x.shape[1] - 1 else 2 ** len(g)
            a, b, c = (np.bincount(code, weights=w, minlength=size) for w in (on, off, times))
            base = (c + 0.5) / (c.sum() + 0.5 * size)
            a, b = (a + 5 * base) / (a.sum() + 5), (b + 5 * base) / (b.sum() + 5)  # few cases say little
            self.ratio.append(np.log(a / b))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for ratio, code in zip(self.ratio, self._codes(x)):
            odds += ratio[code]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def inside(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the voters alone, without the outside evidence; a group's silence says nothing of wording it doesn't know."""
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for ratio, code in list(zip(self.ratio, self._codes(x)))[:-1]:
            odds += np.where(code > 0, ratio[code], 0.0)
        return odds

    @property
    def evidence(self) -> np.ndarray:
        """Log-likelihood ratio of each outside state."""
        return self.ratio[-1]


class AbuseModel:
    def __init__(self):
        self.labels: dict[str, LabelModel] = {}
        self.weights = {c: np.zeros(1 << BITS, dtype=np.float32) for c in CATEGORIES}
        self.trust = dict.fromkeys(CATEGORIES, 1.0)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int] | None = None, counted: tuple[np.ndarray, np.ndarray] | None = None, calm: int = CALM_SENTENCES) -> AbuseModel:
        """Label models from ``counted`` patterns, or else those of the texts; classifiers from the texts.

        labels: a code per text, see ``label_codes``.  Of the sentences without evidence ``calm`` are learned from, weighed up.
        """
        m, b = cls(), Batch(texts)
        if not len(b.owner):
            return m
        outside = b.outside(labels or [0] * len(texts), strong_votes(b.votes))
        if counted is None:
            counted = _distinct(np.hstack([b.votes, outside]).astype(np.int64))
        patterns, times = counted
        if not patterns[:, : len(VOTERS)].any():
            return m
        known = (b.votes[:, _ONES.any(1)].any(1)) | ((outside % 3 == 1) | (outside >= 3)).any(1)
        calm_ones = np.flatnonzero(~known)
        used, cost = known.copy(), np.ones(len(known))
        if len(calm_ones) > calm:
            cost[calm_ones] = len(calm_ones) / calm
            calm_ones = np.random.default_rng(5).choice(calm_ones, calm, replace=False)
        used[calm_ones] = True
        votes, outside, cost, owner = b.votes[used], outside[used], cost[used], b.owner[used]
        row, col, scale = b.features(used)
        del b
        active, col = np.unique(col, return_inverse=True)
        for k, c in enumerate(CATEGORIES):
            use, speaks = _voters_of(c), np.array([float(VOTERS[j][1] == c) for j in _voters_of(c)])
            mine, n = _distinct(np.hstack([patterns[:, use], patterns[:, [len(VOTERS) + k]]]), times)
            label = m.labels[c] = LabelModel(mine, n, speaks)
            x = np.hstack([votes[:, use], outside[:, [k]]]).astype(np.int64)
            w, m.trust[c] = cls._train(row, col, scale, label.inside(x), label.evidence[x[:, -1]], np.where(x[:, -1] == 1, owner, -1), cost, len(active))
            m.weights[c][active] = w
        return m

    @staticmethod
    def _train(row: np.ndarray, col: np.ndarray, scale: np.ndarray, prior: np.ndarray, evidence: np.ndarray, together: np.ndarray, cost: np.ndarray, n_columns: int) -> tuple[np.ndarray, float]:
        """Weights of words and pairs, and of the voters' log-odds, that make the outside evidence most likely; Adam over all rows.

        The likelihood of a row is s(z) L1 + (1 - s(z)) L0, with z the classifier's log-odds and L1/L0 the ratio of its
        evidence, so its gradient is the posterior less s(z).  What reviewers alone say of a document's sentences (those
        ``together``) is that one of them is of the category, not all: there s is the chance of any, by a noisy or.
        Weights shrink towards zero, that is towards the label model.
        """
        joint = np.flatnonzero(together >= 0)
        _, group = np.unique(together[joint], return_inverse=True)
        ratio = np.exp(np.clip(evidence[joint], -10, 10))
        w, trust, m1, m2 = np.zeros(n_columns), 1.0, np.zeros(n_columns + 1), np.zeros(n_columns + 1)
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for t in range(1, STEPS + 1):
            z = trust * prior + scale * np.bincount(row, weights=w[col], minlength=len(prior))
            d = s(z + evidence) - s(z)
            if len(joint):
                each = s(z[joint])
                none = np.exp(np.bincount(group, weights=np.log1p(-np.minimum(each, 1 - 1e-9))))[group]
                d[joint] = each * none * (ratio - 1) / ((1 - none) * ratio + none)
            d *= cost
            g = np.append(np.bincount(col, weights=(d * scale)[row], minlength=n_columns) - SHRINK * w, (d * prior).sum() - 50.0 * (trust - 1))
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-3)
            w += step[:-1]
            trust = float(np.clip(trust + 0.2 * step[-1], 0.3, 1.5))
        return w.astype(np.float32), trust

    def odds(self, b: Batch) -> np.ndarray:
        """Log-odds per sentence and category."""
        row, col, scale = b.features()
        out = np.full((len(b.owner), len(CATEGORIES)), -30.0)
        for k, c in enumerate(CATEGORIES):
            if c in self.labels:
                x = np.hstack([b.votes[:, _voters_of(c)], np.zeros((len(b.owner), 1), dtype=bool)]).astype(np.int64)
                out[:, k] = self.trust[c] * self.labels[c].inside(x) + scale * np.bincount(row, weights=self.weights[c][col], minlength=len(b.owner))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability per text and category, that of the worst sentence; a sentence counts for the category it speaks of most."""
        out, b = np.zeros((len(texts), len(CATEGORIES))), Batch(texts)
        if not len(b.owner) or not self.labels:
            return out
        z = self.odds(b)
        z = np.where(z < z.max(1, keepdims=True), np.minimum(z, -z.max(1, keepdims=True)), z)
        np.maximum.at(out, b.owner, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def _distinct(x: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows, inverse = np.unique(x, axis=0, return_inverse=True)
    return rows, np.bincount(inverse.ravel(), weights=times, minlength=len(rows))


def label_codes(labels: DataFrame) -> DataFrame:
    """(doc_id, said): two bits a category, 1 where most reviewers name it, 2 where they name something else; ties are against it.

    labels: doc_id, label.  Labels other than a category or ``none`` say nothing; repeated rows count as often as they are there.
    """
    said = F.lower(F.trim("label"))
    sound = labels.where(F.col("doc_id").isNotNull() & said.isin("none", *CATEGORIES)).select("doc_id", said.alias("label"))
    n = sound.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == c).alias(c) for c in CATEGORIES))
    code = sum((F.when(2 * F.col(c) > F.col("n"), 1).otherwise(2) * 4**k for k, c in enumerate(CATEGORIES)), F.lit(0))
    return n.select("doc_id", code.cast("int").alias("said"))


def firing_patterns(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of votes and outside evidence of the sentences of all documents (doc_id, text, said), and how many have each."""
    shift = len(VOTERS)

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = Batch(pdf.text.tolist())
            outside = b.outside(pdf.said.tolist(), strong_votes(b.votes))
            code = b.votes @ (1 << np.arange(shift, dtype=np.int64)) + (outside << (shift + 3 * np.arange(len(CATEGORIES)))).sum(1)
            pattern, n = np.unique(code, return_counts=True)
            yield pd.DataFrame({"pattern": pattern, "n": n})

    each = documents.where("doc_id is not null and text <> ''").select("text", "said").mapInPandas(fire, "pattern long, n long")
    rows = each.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # few of the possible patterns occur
    code, n = np.array([r.pattern for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.int64)
    votes = code[:, None] >> np.arange(shift) & 1
    return np.hstack([votes, code[:, None] >> (shift + 3 * np.arange(len(CATEGORIES))) & 7]), n


def fit_on(documents: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> AbuseModel:
    """A model whose voters are judged on all documents, its classifier fitted on ``sample`` picked by hash and as many of the labelled ones.

    documents: doc_id, text; labels: doc_id, label.
    """
    docs = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    if labels is None:
        docs = docs.withColumn("said", F.lit(0))
    else:
        docs = docs.join(label_codes(labels), "doc_id", "left").select("doc_id", "text", F.coalesce("said", F.lit(0)).alias("said"))
    rows = {r.doc_id: r for part in (docs, docs.where("said <> 0"))[: 1 if labels is None else 2] for r in sampled(part, sample, "doc_id").collect()}
    return AbuseModel.fit([r.text for r in rows.values()], [r.said for r in rows.values()], firing_patterns(docs))


def abuse_scores(documents: DataFrame, model: AbuseModel) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual) with a probability each; null or empty texts score 0, copies each have a row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of cells

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "source"]].copy()
            out[list(CATEGORIES)] = shared.value.score(pdf.text.fillna("").tolist())
            yield out

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id long, source string, abuse double, hate double, sexual double")


def source_rates(scores: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Documents, flagged documents and their rate per source and category; sources differ in writing only."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), (F.col(c) >= limit).alias("hit")) for c in CATEGORIES)))
    long = scores.select(plain_source(F.col("source")).alias("source"), each.alias("x"))
    return long.groupBy("source", "x.category").agg(F.count("*").alias("n_documents"), F.count_if("x.hit").alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_documents"), 6))
