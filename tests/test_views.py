from pyspark.sql import functions as F

from webloom.operators import views

PAGES = "url string, final_status_code int, title string, meta_description string, h1_tags string, canonical_urls array<string>, overall_indexable boolean, at long"


def test_labels_filters_and_windows(spark):
    rows = [("https://h/a/x", 200, "Title", "d", "H", ["c"], True, 0), ("http://h/a/y", 404, None, " ", None, [], None, None), ("https://h/b", None, "other", "d", "h", None, False, 60)]
    p = spark.createDataFrame(rows, PAGES)
    got = {r.url: r for r in p.select("url", views.tabs().alias("t"), views.status_label(F.col("final_status_code")).alias("l"), views.status_tone(F.col("final_status_code")).alias("s"), views.iso_time(F.col("at")).alias("i"), views.length_tone(F.length("title"), 6, 60).alias("n")).collect()}
    assert got["https://h/a/x"].t == [] and got["http://h/a/y"].t == ["canonicals", "descriptions", "headings", "response-codes", "security", "titles"]
    assert (got["https://h/a/x"].l, got["https://h/a/x"].s, got["http://h/a/y"].s, got["https://h/b"].l) == ("OK", "ok", "bad", "") and got["https://h/b"].i == "1970-01-01T00:01:00Z"
    assert [got[u].n for u in ("https://h/a/x", "http://h/a/y", "https://h/b")] == ["warn", "bad", "warn"]
    assert views.filtered(p, "TITLE").count() == 1 and views.filtered(p, tab="titles").count() == 1 and views.filtered(p, failing=True).count() == 1 and views.filtered(p).count() == 3
    assert [r.url for r in views.window_of(p, 1, 1).collect()] == ["https://h/a/x"] and views.window_of(p, 0).count() == 1
    assert [(r.section, r.pages) for r in views.site_structure(p).collect()] == [("a", 2), ("b", 1)]
    pairs = spark.createDataFrame([(0.9, "sibling", "https://h/A", "https://h/b", ""), (0.95, "sibling", "c", "d", "time-sequenced")], "sim double, relation string, url_a string, url_b string, pair_class string")
    assert views.pairs_filtered(pairs, 0.92).count() == 1 == views.pairs_filtered(pairs, text="h/a").count() == views.pairs_filtered(pairs, hide_sequenced=True).count() and views.pairs_filtered(pairs, relation="x").count() == 0
    risks = spark.createDataFrame([("duplicate — x",), ("",), ("thin content",)], "r string").select(views.risk_bucket(F.col("r")).alias("b")).collect()
    assert [r.b for r in risks] == ["duplicate", "none", "thin"]
