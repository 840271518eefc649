from urllib.parse import parse_qsl, urlencode, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.plans import url_queries


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.x for r in df.select("i", f(F.col("u")).alias("x")).orderBy("i").collect()]


def test_normalise(spark):
    cases = {
        "HTTPS://Host.Example/A/Index.php?utm_source=x&b=2&gclid=1&a=#f": "https://host.example/a?b=2&a=", "https://h": "https://h/", "https://h/x/": "https://h/x", "https://h/?q=a b~*": "https://h/?q=a+b~%2A",
        "": "", None: "", "  ": "", "https://h/x?flag": "https://h/x?flag=", "https://h/a%zz?p=%zz": "https://h/a%zz?p=%25zz",
    }
    assert column(spark, list(cases), urls.normalise_url) == list(cases.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab-_.~* é", max_size=4), st.text("xy+ %&=", max_size=4)), max_size=3), st.text("abAB/", max_size=6))
def test_normalise_agrees_with_the_standard_library(spark_session_holder, pairs, path):
    url = f"https://h.example/{path}?{urlencode(pairs)}"
    p = urlparse(url)
    query = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True)])
    want = f"https://h.example{p.path.lower().rstrip('/') or '/'}{'?' + query if query else ''}"
    assert column(spark_session_holder, [url], urls.normalise_url) == [want]


def test_relations(spark):
    h = "https://h"
    cases = [(h, f"{h}/a", "parent-child"), (f"{h}/video", f"{h}/videos", "cross-section"), (f"{h}/a/b", f"{h}/a/c/", "sibling"), (f"{h}/a/b/c", f"{h}/a/d", "same-section"), (f"{h}/a", "https://g/a", "cross-section"), (f"{h}/a?utm_x=1", f"{h}/A/", "sibling"), (f"{h}/a", f"{h}/a/b", "parent-child"), (f"{h}/a", f"{h}/b", "cross-section")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", urls.url_relation(F.col("a"), F.col("b"))).collect())


def test_amp_variants_and_scope(spark):
    assert column(spark, ["https://h/foo/amp", "https://h/amp", "https://h/revamp", "https://h/f?x=1&amp=1", "https://h/f/AMP/", "https://h/f?amp=2"], urls.amp_base_url) == ["https://h/foo", "https://h/", None, "https://h/f?x=1", "https://h/f/", None]
    kinds = column(spark, ["https://h/A/b.html?q#f"], urls.url_variants)[0]
    assert {(k.kind, k.variant) for k in kinds} == {("trailing_slash", "https://h/A/b.html/?q#f"), ("suffix_php", "https://h/A/b.html.php?q#f"), ("suffix_aspx", "https://h/A/b.html.aspx?q#f"), ("case", "https://h/A/B.HTML?q#f")}
    f = lambda u: urls.reject_reason(u, ["h"], ["private"], "/o")
    assert column(spark, ["ftp://h/o", "no scheme", "https://u:p@h/o", "https://g/o", "https://h/private/o", "https://h/x", "https://h/o"], f) == ["unsupported_scheme", "malformed_url", "credential_url", "host_out_of_scope", "path_exclude", "path_restriction", None]
    assert column(spark, ["https://h/a/b?x", "https://h/p.pdf"], lambda u: urls.priority_score(u, F.lit(2))) == [76.0, 68.0]
    assert column(spark, ["https://h/a/https://g:80/b?c", "mailto:x", "http://h/x.PDF", " "], lambda u: urls.clean_archive_url(u, [".pdf"], ["/api"])) == ["https://g/b?c", None, None, None]
    assert urls.replacements_from(["a=b=c"]) == [("a", "b=c")]
    assert column(spark, ["https://www.a.b:1/x", "https://z/"], lambda u: urls.user_agent_for(u, {"a.b": "one"}, "two")) == ["one", "two"]
    assert column(spark, ["https://h/news/x", "https://h/newsletter"], lambda u: urls.in_section(u, "/News/")) == [True, False]


def test_address_key(spark):
    got = column(spark, ["http://WWW.h.example:80//A//index.html?b=2&utm_x=1&a=1#f", "https://h.example/a?a=1&b=2", " ", None, "https://h.example"], urls.address_key)
    assert got == ["h.example/a?a=1&b=2"] * 2 + [None, None, "h.example"]


def test_simhash_constants(spark):
    """Known fingerprints of two short texts, one in its signed form."""
    df = spark.createDataFrame([(1, "apple cedar ember"), (2, ""), (3, None), (4, "!!")], "i int, t string")
    assert {r.i: r.simhash for r in text.simhash64(df, "i", "t").collect()} == {1: -6955753827659690935, 2: 0, 3: 0, 4: 0}


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)}
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    got = {(r.a, r.b, r.distance) for r in text.near_pairs(spark.createDataFrame(signed * 2 + [(None,)], "h long"), "h").collect()}
    want = {(a, b, d) for (a,) in signed for (b,) in signed if a < b and (d := ((a ^ b) % 2**64).bit_count()) <= 4}
    assert got == want and want


def test_near_links_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(60)}
    prints |= {7 << 40 | (1 << k) - 1 for k in range(0, 40, 3)}  # a chain
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4]
    root = {h: h for h in signed}
    for _ in signed:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {h: (sum(h in p for p in pairs), root[h]) for h in {x for p in pairs for x in p}}
    df = spark.createDataFrame([(h,) for h in signed] * 2 + [(None,)], "h long")
    for block, cell, short in ((5, 40, 2), (9, 10_000, 64), (16_384, 50_000, 1)):
        text.SHORT, kept = short, text.SHORT
        try:
            near = text.near_links(df, "h", block=block, cell=cell).collect()
        finally:
            text.SHORT = kept
        n, up = {}, {h: h for h in signed}
        for r in near:
            n[r.h] = n.get(r.h, 0) + r.n
        for _ in signed:
            for r in near:
                up[r.h] = up[r.root] = min(up[r.h], up[r.root])
        assert {h: (k, up[h]) for h, k in n.items()} == want and len(want) > 100
    assert text.near_links(df.limit(0), "h").count() == 0


def test_near_duplicates_are_counted_without_their_pairs(spark, tmp_path):
    """4,000 texts whose fingerprints are nearly all alike: some hundred thousand pairs, of which nothing is shuffled but sums."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*words, *(f"x{rng.randrange(10**6)}" for _ in range(5))])) for i in range(4000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    rows = {r.doc_id: r for r in url_queries.simhash_near_dups(spark, str(tmp_path)).collect()}
    shuffled = written() - before
    prints = {r.doc_id: r.simhash for r in url_queries.doc_simhash(spark, str(tmp_path)).collect()}
    each = set(prints.values())
    want = {h: sum(h != g and ((h ^ g) % 2**64).bit_count() <= 4 for g in each) for h in each}
    assert {i: r.n_links for i, r in rows.items()} == {i: want[h] for i, h in prints.items()} and sum(want.values()) > 500_000
    assert shuffled < 1_000_000

def test_verdicts_and_signatures(spark):
    rows = [("a", "a", None, "identical"), ("a", "b", 4, "near"), ("a", "b", 5, "changed"), (None, "b", None, "unknown"), (None, None, 3, "near"), ("a", "b", None, "changed")]
    df = spark.createDataFrame(rows, "x string, y string, d int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.content_verdict(F.col("x"), F.col("y"), F.col("d"))).collect())
    df = spark.createDataFrame([("Home | Shop", "Home", "Shop"), ("Home | Shop", None, "Shop"), ("Shop", None, "Shop"), ("A | B | Shop", "A", None), (None, "A", "B"), ("Home - x – Shop", None, "Shop")], "t string, p string, s string")
    assert [r.x for r in df.select(text.without_boilerplate(F.col("t"), F.col("p"), F.col("s")).alias("x")).collect()] == ["", "Home", "", "B | Shop", "", "Home - x"]
    pages = [("https://h/1", f"T{i} | Shop") for i in range(3)] + [("https://h/2", "plain"), ("https://g/1", "X | Y"), ("https://h/3", None)]
    assert [tuple(r) for r in text.title_boilerplate(spark.createDataFrame(pages, "url string, title string")).collect()] == [("h", None, "Shop")]
    assert column(spark, [None, "", " a  b\nc "], text.word_count) == [0, 0, 3] and column(spark, [None, "a"], text.is_thin) == [False, True]
