import math

from pyspark.sql import functions as F

from webloom.llm.mixing import mix_sources, token_counts


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double").withColumn("share", F.lit("clash"))
    rows, report = mix_sources(d, spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int"), **kw)
    return {(r.mix, r.doc_id): r.copies for r in rows.collect()}, {(r.mix, r.source): r for r in report.collect()}


def test_shares_caps_and_names(spark):
    docs = [(i, "Big_A ", 10, 1.0) for i in range(500)] + [(1000 + i, "small", 10, None) for i in range(20)] + [(2000, "small", 0, 1.0), (2001, None, 5, 1.0)]
    targets = [("m", "big-a", 3.0, None), ("m", "SMALL", 1.0, 4), ("m", "small ", 0.0, None), ("m", "absent", 1.0, 2), (None, "small", 1.0, 1)]
    copies, report = run(spark, docs, targets)
    assert {copies["m", 1000 + i] for i in range(20)} == {4} and report["m", "small"].most_copies == 4
    assert abs(report["m", "small"].actual_share - 0.25) < 0.005 and abs(report["m", "big-a"].actual_share - 0.75) < 0.005
    assert report["m", "absent"].tokens == 0 and ("m", 2000) not in copies
    by_range, _ = run(spark, docs, targets, rows_per_range=7)
    assert by_range == copies
    over, short = run(spark, docs, targets, total=10_000)
    assert short["m", "small"].tokens == 800 and max(over.values()) == 4


def test_heavier_records_come_first(spark):
    docs = [(i, "s", 10, 8.0 if i % 2 else 0.5) for i in range(1000)]
    copies, _ = run(spark, docs, [("m", "s", 1.0, None)], total=3000)
    heavy = sum(1 for _, i in copies if i % 2)
    assert len(copies) == 300 and heavy > 250


def test_size_or_shares(spark):
    docs = [(i, "big", 10, 1.0) for i in range(400)] + [(1000 + i, "tiny", 10, 1.0) for i in range(4)]
    targets = [("m", "big", 0.5, None), ("m", "tiny", 0.5, 2)]
    _, shares = run(spark, docs, targets)
    assert shares["m", "tiny"].tokens == 80 and shares["m", "big"].tokens == 80 and shares["m", "big"].full_tokens == 2020
    _, size = run(spark, docs, targets, keep_shares=False)
    assert size["m", "tiny"].tokens == 80 and abs(size["m", "big"].tokens - 2020) <= 10 and size["m", "tiny"].actual_share < 0.05


def test_no_range_is_hot_whatever_the_weights(spark):
    """Ranges by the logarithm of the key: the fullest holds little more than its part, with all weights near zero too."""



    for weight in (1e-6, 0.05, 1.0):
        key = -F.log((F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 52)) + 0.5) / (1 << 52)) / weight
        ranges = math.ceil(100_000 / (math.e * 1000))
        top = spark.range(100_000).groupBy(F.floor(F.log(key) * ranges)).count().agg(F.max("count")).first()[0]
        assert top < 1300, (weight, top)


def test_empty(spark):
    assert run(spark, [], [("m", "s", 1.0, 1)])[0] == {}
    assert run(spark, [(1, "s", 5, 1.0)], []) == ({}, {})


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 == got[3] and got[4] > 1
