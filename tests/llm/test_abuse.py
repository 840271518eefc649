import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm.abuse import CATEGORIES, VOTERS, AbuseModel, Batch, LabelModel, abuse_scores, fit_on, label_codes, restored, source_rates, tokens

CALM = [
    "The workshop calendar lists the opening hours.", "The redirect map was checked on day 12.", "A visitor asked for the warranty terms.",
    "The guide explains how to oil oak.", "Rain barrels are sold in two sizes.", "Our shop moved to the old mill.", "Orders leave the depot before noon.",
]
BAD = {
    "abuse": ["You pathetic moron, shut it.", "I hate you, you stupid pig.", "What a worthless idiot you are.", "Die already, you filthy coward."],
    "hate": ["They are all vermin and parasites.", "Deport them all, those rats.", "These people are filth, they are not human.", "Thieves and liars, all of them, subhuman scum."],
    "sexual": ["Free porn clips with horny girls.", "Naked webcam show tonight, hardcore.", "She moaned as he stripped her nude.", "Cheap escorts for sex tonight."],
}
# nothing in these is on a list; they are learned from the company they keep
HELD_OUT = {"abuse": "Kindly feed yourself to the geese.", "hate": "Nobody wants their kites over our town.", "sexual": "Ask for the velvet menu upstairs."}
HARMLESS = "The moron bridge, a stupid idiot of a name, opens at noon."


def corpus(seed=1):
    """(texts, labels): 3,000 documents, of which 60 a category are bad; half of these hold the held-out sentence too."""
    rng, texts, said = random.Random(seed), [], []
    for n in range(3000):
        body, code = rng.choices(CALM, k=5), 0
        if n < 180:
            k = n % 3
            body.insert(rng.randrange(5), rng.choice(BAD[CATEGORIES[k]]))
            body.insert(rng.randrange(5), HELD_OUT[CATEGORIES[k]] if n % 2 else rng.choice(BAD[CATEGORIES[k]]))
            code = sum((1 if j == k else 2) * 4**j for j in range(3)) if n % 4 == 0 else 0
        elif n < 260:
            body.insert(2, HARMLESS)
        texts.append(" ".join(body))
        said.append(code)
    return texts, said


def test_disguises():
    assert [restored(w) for w in ("m0r0n", "b*****d", "idiiiiiot", "$h0t", "40", "12kg", "moron")] == ["moron", "bastard", "idiot", "shot", "0", "12kg", "moron"]
    assert tokens("Such a m o r o n! L'été\nx") == ["such", "a", "moron", "!", "lete", "\n", "x"]


def test_votes():
    b = Batch(["You are such a moron. The gate opens.\nPorn", "", None, "..."])
    names = [{VOTERS[k][0] for k in np.flatnonzero(v)} for v in b.votes]
    assert {"insult near you", "insult", "slighted insult"} <= names[0] and not names[1] and names[2] == {"explicit"} and b.owner.tolist() == [0, 0, 0]


def test_wording_off_the_lists_is_learned_and_harmless_use_unlearned():
    texts, said = corpus()
    m = AbuseModel.fit(texts, said)
    for k, c in enumerate(CATEGORIES):
        s = m.score([CALM[1] + "\n" + t for t in [HELD_OUT[c], *BAD[c]]])
        assert (s[:, k] >= 0.5).all() and (s.argmax(1) == k).all(), (c, s)
    assert (m.score([HARMLESS, *CALM]) < 0.5).all() and m.score(["", None, "...", "x " * 100_000]).shape == (4, 3)
    assert (m.score(["Never seen words altogether, gribble frotz."]) < 0.5).all()


def test_held_out_documents():
    """Precision and recall on documents the model has not seen; the frames without a listed word are a third of the bad ones."""
    m = AbuseModel.fit(*corpus(1))
    texts, _ = corpus(2)
    found = m.score(texts) >= 0.5
    truth = np.zeros_like(found)
    truth[np.arange(180), np.arange(180) % 3] = True
    both = (found & truth).sum()
    assert both / found.sum() > 0.98 and both / truth.sum() > 0.95


def test_label_model_tells_good_voters_from_bad_and_joins_copies():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.05
    good, fair, odd = (np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in ((0.7, 0.001), (0.4, 0.002), (0.05, 0.05)))
    outside = np.where(y, rng.random(len(y)) < 0.4, rng.random(len(y)) < 0.01) * 3
    x = np.stack([good, fair, fair, odd, outside], 1).astype(np.int64)
    m = LabelModel(x, np.ones(len(x)), np.array([1.0, 1, 1, 1]))
    assert any({1, 2} <= set(g) for g in m.groups) and m.evidence[3] > 2 > 0 > m.evidence[0]
    p = m.posterior(x)
    assert p[y & good].mean() > 0.85 and p[~y].mean() < 0.05 and p[~y & odd].mean() < 0.2


def test_scores_and_rates(spark):
    texts, said = corpus()
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, ["Blog", "blog ", "FORUM"] * 1000))] + [(9000, None, "blog"), (9001, "", None), (9002, "x " * 30_000, "blog"), (None, "You moron", "x")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string").withColumn("abuse", F.lit("clash"))
    labels = [(i, CATEGORIES[i % 3], "r") for i, c in enumerate(said) if c] + [(5, "none", "r"), (5, "unsure", "r"), (None, "abuse", "r"), (7, None, None)]
    m = fit_on(df, spark.createDataFrame(labels, "doc_id long, label string, reviewer string"))
    scores = abuse_scores(df, m)
    out = {r.doc_id: r for r in scores.collect()}
    assert scores.count() == len(rows) + 1 and out[9000].abuse == 0 == out[9001].hate and out[9002].sexual < 0.5
    assert all(max(out[i][c] for c in CATEGORIES) >= 0.5 for i in range(180))
    rates = {(r.source, r.category): r for r in source_rates(scores).collect()}
    assert {k[0] for k in rates} == {"blog", "forum", "x", None} and rates["blog", "abuse"].n_flagged > 0
    assert abuse_scores(df.limit(0), fit_on(df.limit(0))).count() == 0


def test_a_small_sample_still_counts_all_patterns(spark):
    texts, _ = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = fit_on(docs, sample=50)
    assert (m.score(BAD["sexual"])[:, 2] >= 0.5).all() and not (m.score(CALM) >= 0.5).any()


def test_label_codes(spark):
    rows = [(1, "abuse"), (1, " Abuse"), (1, "none"), (2, "hate"), (2, "none"), (3, "unsure"), (4, None), (None, "hate")]
    got = {r.doc_id: r.said for r in label_codes(spark.createDataFrame(rows, "doc_id long, label string")).collect()}
    assert got == {1: 1 + 2 * 4 + 2 * 16, 2: 2 + 2 * 4 + 2 * 16}
