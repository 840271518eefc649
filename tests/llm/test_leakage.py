import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm.leakage import Items, alike, leaked_passages, longest_matches, search_shard, suffix_array, without_leaks, words_of

ITEM = "The keeper of Caltaldru wrote that handle and drawer were traded at 433 to 8 beside the Mirnibpal gate while Lowfencal slept"


KIN = [(i, f"The keeper of Name{i}a wrote that handle and drawer were traded at {i}77 to 3{i} beside the Name{i}b gate while Name{i}c slept") for i in range(20, 24)]


def found(spark, texts, items=((7, ITEM), *KIN)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    return {(r.doc_id, r.item_id) for r in leaked_passages(docs, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_what_counts(spark):
    near = "x y <p>THE keeper  of Caltáldru wrote,\n that handle and **drawer** were tarded at 433 to beside the Mirnibpal gate while z"
    other = "The keeper of Ricvenlow wrote that handle and drawer were traded at 12 to 9 beside the Epsadpal gate while Visquin slept"
    texts = [ITEM, near, other, "He said: keeper of Caltaldru wrote that handle", "", None, "unrelated", "a " * 50_000 + ITEM, ITEM]
    assert found(spark, texts) == {(0, 7), (1, 7), (7, 7), (8, 7)}
    assert found(spark, ["nothing", "one two three four here"], [(1, "one two three four"), (2, ""), (3, None)]) == {(1, 1)}
    assert found(spark, texts, []) == set() == found(spark, [None])


def test_many_copies_do_not_break_chains():
    words = words_of(ITEM)
    edited = ["zzz" if k % 5 == 4 else w for k, w in enumerate(words)]
    doc = [w for _ in range(12) for w in [*edited, *["filler"] * 20]]
    assert [(d, i) for d, i, *_ in search_shard(Items([7, *(i for i, _ in KIN)], [ITEM, *(t for _, t in KIN)]), [doc], 15, 0.75)] == [(0, 0)]


def test_removal_and_places(spark):
    docs = spark.createDataFrame([(1, "a b c " + ITEM + " d"), (2, "clean"), (2, "clean"), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), *KIN], "item_id long, text string")
    leaks = leaked_passages(docs, items)
    assert sorted(str(r.doc_id) for r in without_leaks(docs, leaks).collect()) == ["2", "2", "None"]
    (r,) = leaks.collect()
    n = len(words_of(ITEM))
    assert (r.n_words, r.longest, r.doc_at, r.doc_end, r.item_at) == (n, n, 3, 3 + n, 0)
    with pytest.raises(ValueError):
        leaked_passages(docs, items, most_words=20)


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for top in (2, 3, 1 << 40):
        ids = [rng.choice([0, 1, 2, top]) if rng.random() < 0.9 else 1 for _ in range(400)] + [1] * 50 + [0]
        begin = [k for k, x in enumerate(ids) if x]

        def rest(k):
            return ids[k : ids.index(0, k)]

        got = suffix_array(np.array(ids, dtype=np.int64), np.array(begin))
        assert sorted(got.tolist()) == begin and [rest(k) for k in got] == sorted(map(rest, begin))


def test_telling_matches_are_those_with_a_rare_word():
    items = Items([7, *(i for i, _ in KIN)] * 20, [ITEM, *(t for _, t in KIN)] * 20)
    ids = np.array([items.number.get(w, 0) for w in words_of("wrote that handle and drawer were traded at x keeper of caltaldru wrote")], dtype=np.int64)
    every = longest_matches(items, ids)[2]
    assert len(every) > 0 and len(longest_matches(items, ids, telling=True)[2]) == 0  # all words are common to twenty items


def test_longest_matches_against_brute_force():
    rng = random.Random(2)
    items = Items([1, 2], [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(2)])
    words = [rng.choice("abcdx") for _ in range(200)]
    ids = [items.number.get(w, 0) for w in words]
    p, q, n = longest_matches(items, np.array(ids))
    flat = items.flat.tolist()
    want = set()
    for i in range(len(ids)):
        for j in range(len(flat)):
            if ids[i] and ids[i] == flat[j] and not (i and j and ids[i - 1] == flat[j - 1] and ids[i - 1]):
                k = 0
                while i + k < len(ids) and j + k < len(flat) and ids[i + k] and ids[i + k] == flat[j + k]:
                    k += 1
                if k >= 3:
                    want.add((i, j, k))
    assert set(zip(p.tolist(), q.tolist(), n.tolist())) == want


def test_words():
    assert words_of("<b>Façade</b> &amp; STRASSE\n12-b") == ["facade", "strasse", "12", "b"]
    assert alike("traded", "tarded") and alike("spider", "spidr") and not alike("12", "13") and not alike("gate", "gift")
