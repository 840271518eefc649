from pyspark.sql import functions as F

from webloom.functions import detect
from webloom.operators import compare

PAIRS = [("https://o/a", "https://n/a"), ("https://o/b", "https://n/b"), ("https://o/c", "https://n/c"), ("https://o/d", "https://n/d"), ("https://o/e", "https://n/e"), ("https://o/f", "https://n/f"), ("https://o/g", "https://n/a"), ("https://o/h", "https://n/h"), ("https://n/a", "https://n/a/")]
ANSWERS = [
    ("https://o/a", "https://n/a", 200, [301], "s1", 255), ("https://o/b", "https://n/b", 200, [301, 301], "s2", 254), ("https://o/c", "https://n/c", 200, [302], "s3", 0), ("https://o/d", "https://o/d", 200, [], "s4", 7),
    ("https://o/e", "https://n/x", 200, [301], "s5", 7), ("https://o/f", "https://o/f", 404, [], None, None), ("https://o/h", "https://n/h", 200, [301], "s6", 1), ("https://n/a", "https://n/a", 200, [], "s1", 255), ("https://n/b", "https://n/b", 200, [], "s9", 255),
]


def test_redirect_verdicts(spark):
    pages = spark.createDataFrame(ANSWERS, "requested_url string, final_url string, status int, hops array<int>, sha256 string, simhash long")
    for c in ("title", "h1", "meta_description"):
        pages = pages.withColumn(c, F.lit(None).cast("string"))
    rows = compare.pair_rows(spark.createDataFrame(PAIRS, "source_url string, target_url string"), pages.withColumn("word_count", F.lit(1)))
    got = {r.source_url[-3:]: (r.redirect_verdict, r.content_verdict) for r in rows.collect()}
    assert got == {
        "o/a": ("redirect_ok", "identical"), "o/b": ("redirect_chain", "near"), "o/c": ("redirect_temporary", "identical"), "o/d": ("no_redirect", "missing"), "o/e": ("redirect_wrong_target", "missing"),
        "o/f": ("error_status", "missing"), "o/g": ("not_crawled", "missing"), "o/h": ("redirect_ok", "identical"), "n/a": ("no_redirect_expected", "missing"),
    }
    assert {r.source_url[-3:] for r in compare.failing(rows, "any").collect()} == {"o/d", "o/e", "o/f", "o/g"}


def test_challenge_pages(spark):
    rows = [(503, "", "Just a moment... <script>window.__cf_chl_opt={}</script>"), (403, "", "please wait px-captcha"), (403, "_abck=1", "x"), (200, "_abck=1", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "status int, cookie string, body string").withColumn("headers", F.create_map(F.lit("SET-Cookie"), "cookie"))
    assert [r.v for r in df.select(detect.challenge(F.col("status"), F.col("headers"), F.col("body")).alias("v")).collect()] == ["cloudflare", "perimeterx", "akamai", None, None]
