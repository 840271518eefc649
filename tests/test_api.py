import pytest
from pyspark.sql import functions as F

from webloom import api


def test_signatures_vectors_and_overlap(spark):
    words = "oak bench rain barrel shelf lamp"
    pages = spark.createDataFrame([(1, "https://h/a", "A | Shop", "x", None, words * 5), (2, "https://h/b", "B | Shop", "x", None, words * 5), (3, "https://h/c", "C | Shop", "y", None, "quite another text")], "url_id long, url string, title string, h1 string, meta_description string, main_text string")
    sig = api.backfill_signatures(pages, 0.5)
    assert {r.url_id: r.signature_model_input.split("\n")[0] for r in sig.collect()} == {1: "A", 2: "B", 3: "C"}
    none = spark.createDataFrame([], "url_id long, signature_hash string, embedding_model string")
    vec = api.generate_embeddings(sig, none)
    recs = vec.join(sig, ["url_id", "signature_hash"]).join(pages.select("url_id", "url"), "url_id").select(F.lit("r").alias("run_id"), "url_id", "url", F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("hreflang_group"), F.lit("en").alias("hreflang_code"), F.lit(5).alias("word_count"), F.lit("high").alias("signal_confidence"), "signature_model_input")
    out = api.intent_overlap(recs)
    assert {(r.a, r.b) for r in out["pairs"].collect()} == {(1, 2)} and out["clusters"].count() == 1 and out["pages"].where("risk <> ''").count() == 2


def test_identity_reports_and_gates(spark, tmp_path):
    edges = spark.createDataFrame([("https://h/a", "https://h/b", "de-AT")], "url string, alt_url string, code string")
    pages = spark.createDataFrame([(1, "https://h/a", " EN "), (2, "https://h/B/", None), (3, "https://h/c", None)], "url_id long, url string, html_lang string")
    got = {r.url_id: (r.hreflang_group, r.lang_bucket) for r in api.hreflang_identity(pages, edges).collect()}
    assert got == {1: ("H0000", "en"), 2: ("H0000", "de"), 3: (None, "unknown")}
    snap = spark.createDataFrame([("r", "https://h/a", "html", 200, True, None)], "run_id string, url string, kind string, final_status_code int, overall_indexable boolean, canonical_urls array<string>")
    assert api.generate_sitemap(snap, str(tmp_path)) == ["sitemap.xml"]
    with pytest.raises(ValueError):
        api.generate_sitemap(snap.withColumn("final_status_code", F.lit(404)), str(tmp_path))
    with pytest.raises(ValueError):
        api.report("nothing", snap, snap)
    t = spark.createDataFrame([(1, "old host text")], "url_id long, text string")
    assert api.rehashed(t, ["old=new"]).first().content_hash_sha256 == spark.range(1).select(F.sha2(F.lit("new host text"), 256)).first()[0]
    p = spark.createDataFrame([("https://h/x", 7), ("https://h/y", 255), ("https://g/x", 7)], "url string, simhash long")
    assert [r.url for r in api.soft_404(p, spark.createDataFrame([("https://h/zzz", 3)], "tested_url string, simhash long"), 1).collect()] == ["https://h/x"]
