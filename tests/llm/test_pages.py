import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm.pages import BoostedTrees, Node, decode, page_bodies, parse


def texts(html):
    return [x.text for x in parse(html) if x.tag == "#"]


def test_pieces():
    html = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><p>A <b>b</b>c&amp;<a href='x'>d</a>\n e<p>second<ul><li>one<li>two</ul><script>if (a<b) x='<p>no</p>';</script><!-- no --><br>tail"
    assert texts(html) == ["A bc&d e", "second", "one", "two", "tail"]
    nodes = parse(html)
    tags = {x.text: nodes[x.parent].tag for x in nodes if x.tag == "#"}
    assert tags["one"] == "li" and tags["second"] == "p"
    assert texts("") == [] and texts("<div") == ["<div"] and texts("</p></div>x") == ["x"] and texts("<table><tr><td>a<td>b<tr><td>c") == ["a", "b", "c"]
    assert texts("<p>" * 5000 + "deep") == ["deep"] and len(texts("<p>word " * 5000)) == 5000


def test_decode_is_the_best_closed_set():
    rng = random.Random(3)
    for _ in range(30):
        nodes = [Node(-1, "root")] + [Node(rng.randrange(i), rng.choice(["#", "div"])) for i in range(1, 9)]
        for x in nodes[1:]:
            if nodes[x.parent].tag == "#":
                nodes[x.parent].tag = "div"
        logit = np.array([rng.gauss(0, 1) for _ in nodes])
        best, sets = -1e9, None
        for mask in range(1 << 8):
            kept = {0} | {i + 1 for i in range(8) if mask >> i & 1}
            if all(nodes[i].parent in kept for i in kept - {0}):
                score = sum(logit[i] for i in kept - {0})
                if score > best:
                    best, sets = score, kept
        assert set(decode(nodes, logit)) == {i for i in sets if nodes[i].tag == "#"}


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    t = BoostedTrees().fit(x[:2000], y[:2000], np.ones(2000))
    assert ((t.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def page(i, rng):
    words = lambda n: " ".join(rng.choice("oak rain bench depot price table order shelf lamp paint".split()) for _ in range(n))
    body = [f"Heading {words(3)} {i}", *(words(18) + "." for _ in range(4))]
    nav = "".join(f"<li><a href='/{k}'>{k}</a></li>" for k in ("Home", "Shop", "Help", "Cart"))
    side = "".join(f"<li><a href='/x'>{words(4)} {rng.random()}</a></li>" for _ in range(4))
    html = f"<body><nav><ul>{nav}</ul></nav><div class='post'><h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:]) + f"<p>Share this page</p></div><div class='side'><p>{words(14)}.</p><ul>{side}</ul></div><footer><p>Imprint</p></footer></body>"
    old = "\n".join([x for x in body if rng.random() < 0.9] + ["Home"] * (rng.random() < 0.2))
    return html, old, body


def test_held_out_pages(spark):
    rng = random.Random(6)
    made = [page(i, rng) for i in range(120)]
    pages = [(i, "https://h.example/a", h) for i, (h, _, _) in enumerate(made)] + [(900, "https://h.example/b", None), (901, None, ""), (None, "x", "<p>x</p>"), (0, "https://h.example/a", made[0][0])]
    old = [(i, o, "high") for i, (_, o, _) in enumerate(made[:80])] + [(900, "a line\n\n a  line \nb", "low"), (901, None, "high"), (5, " ", "high")]
    df = spark.createDataFrame(pages, "id long, url string, html string").withColumn("phrases", F.lit("clash"))
    texts_df = spark.createDataFrame(old, "id long, main_text string, confidence string")
    rows = [tuple(r) for r in page_bodies(df, texts_df).collect()]
    assert len(rows) == len(set(rows))
    got = {}
    for i, f, p in rows:
        got.setdefault((i, f), set()).add(p)
    assert got[900, "main_text"] == {"a line", "b"} and (901, "html") not in got
    right = wrong = missed = 0
    for i, (_, _, body) in enumerate(made):
        if i >= 80:
            right, wrong, missed = right + len(got[i, "html"] & set(body)), wrong + len(got[i, "html"] - set(body)), missed + len(set(body) - got[i, "html"])
    assert wrong + missed <= 0.03 * right
    assert page_bodies(df.limit(0), texts_df.limit(0)).count() == 0
    assert page_bodies(df.where("id = 7"), texts_df.limit(0)).where("piece = 'Imprint'").count() == 1
