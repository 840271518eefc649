import random

from pyspark.sql import functions as F

from webloom.llm.records import newest
from webloom.llm.representatives import prepare, representatives, source_quality

SCHEMA = (
    "run_id string, url_id long, url string, canonical_url string, main_text string, title string, word_count int, status int, "
    "hreflang_code string, extraction_method string, signal_confidence string, fetched_at long, loaded_at timestamp"
)


def row(i, url, canonical=None, text=None, title=None, words=None, status=200, code=None, run="r", at=1):
    return (run, i, url, canonical, text, title, words, status, code, "m", "high", at, None)


def built(spark, rows, change=lambda df: df):
    df = change(spark.createDataFrame(rows, SCHEMA))
    return {(r.run_id, r.group_id): r for r in representatives(newest(df, **prepare(df))).collect()}


def test_links_and_fields(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [
        row(5, "https://h/a", text=text, title=" ", words=9), row(4, "http://www.H/A/index.html?utm_x=1", text="other", title="T", words=None, canonical="https://h/a"),
        row(6, "https://h/p/1", "https://h/a", text + "\nfive\nsix", "U", 50, 404), row(7, "https://h/p/2", "https://h/a", "quite\nanother\ntext", "V", 99),
        row(8, "https://h/p/3", "https://h/a", None, "W", 99), row(4, "https://h/zzz", text="x", at=None), row(9, None, text=text), row(5, "https://h/a", text=text, run="q"),
    ]
    out = built(spark, rows + rows[:2], lambda df: df.withColumn("order", F.lit("clash")).withColumn("own", F.lit(1)))
    assert list(out) == [("r", 4)]
    r = out["r", 4]
    assert (r.survivor_id, r.title_id, r.canonical_id, r.n_members, r.words) == (5, 4, 4, 3, 50)
    assert r.title == "T" and r.canonicals == ["h/a"]


def test_against_brute_force_with_a_hot_canonical(spark):
    rng = random.Random(4)
    rows, texts = [], {}
    for i in range(120):
        base = rng.randrange(12)
        lines = [f"{base}-{k}" for k in range(5) if rng.random() < 0.85] + ["shared line"]
        texts[i] = lines
        rows.append(row(i, f"https://h/{i % 90}", rng.choice([None, "https://h/", "https://h/3"]), "\n".join(lines)))
    link = {i: {i} for i in range(120)}
    for i in range(120):
        for j in range(i):
            a, b = ([r[2], r[3]] for r in (rows[i], rows[j]))
            own = a[0] == b[0]
            near = {x for x in a if x} & {x for x in b if x} and len(set(texts[i]) - set(texts[j])) <= 2 and len(set(texts[j]) - set(texts[i])) <= 2
            if own or near:
                link[i].add(j), link[j].add(i)
    label = {i: i for i in link}
    for _ in link:
        label = {i: min(label[j] for j in n) for i, n in link.items()}
    want = {}
    for i, g in label.items():
        want[g] = want.get(g, 0) + 1
    assert {g: r.n_members for (_, g), r in built(spark, rows).items()} == {g: n for g, n in want.items() if n > 1}


def test_empty(spark):
    assert built(spark, [row(1, "https://h/a")]) == {} == built(spark, [row(1, "https://h/a")], lambda df: df.limit(0))


def test_quality_of_sources(spark):
    rng = random.Random(1)
    claims = []
    for f in range(400):
        true = rng.random() < 0.5
        for s, sens, spec in (("good", 0.95, 0.95), ("fair", 0.85, 0.9), ("shy", 0.4, 0.98)):
            claims.append((f, s, rng.random() < (sens if true else 1 - spec), 1))
    truth, quality, share = source_quality(spark.createDataFrame(claims, "fact long, source string, says boolean, n long"))
    assert truth.count() == 400 and 0.4 < share < 0.6
    assert quality["good"][0] > quality["shy"][0] + 0.3 and all(spec > 0.8 for _, spec in quality.values())
