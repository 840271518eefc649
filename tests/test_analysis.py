import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import compare, identity, overlap, reports, similarity
from webloom.plans import analysis_queries

VEC = "part string, id long, vector array<float>"


def vectors(n=60, dim=8, seed=1, parts=("a", "b")):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    return [(p, i, [float(x) for x in base[rng.integers(12)] + 0.3 * rng.normal(size=dim)]) for p in parts for i in range(n)]


def unit(rows):
    return {(p, i): np.array(v) / np.linalg.norm(v) for p, i, v in rows}


def test_blocks_equal_brute_force(spark):
    rows = vectors()
    u = unit(rows)
    want = {(p, i, j) for p, i in u for q, j in u if p == q and i < j and u[p, i] @ u[p, j] >= 0.8}
    df = spark.createDataFrame(rows + [("a", 900, None), ("a", 901, [0.0] * 8), ("b", 902, [float("nan")] * 8), ("c", 1, [1.0] * 8)], VEC)
    for block in (7, 1000):
        assert {(r.part, r.a, r.b) for r in similarity.cosine_pairs(df, 0.8, block).collect()} == want
        nn = {(r.part, r.id): r.nn for r in similarity.nearest_sims(df, block).collect()}
        assert nn.keys() == u.keys() and all(abs(v - max(u[k] @ x for m, x in u.items() if m != k and m[0] == k[0])) < 1e-6 for k, v in nn.items())
    assert similarity.cosine_pairs(df.limit(0), 0.8).count() == 0


def test_vectors_of_two_lengths_in_a_part_lose_no_pairs(spark):
    rows = [*vectors(20, 8, 1, ("a",)), *((p, i + 100, v) for p, i, v in vectors(20, 5, 2, ("a",)))]
    u = unit(rows)
    want = {(p, i, j) for p, i in u for q, j in u if p == q and i < j and len(u[p, i]) == len(u[p, j]) and u[p, i] @ u[p, j] >= 0.8}
    df = spark.createDataFrame(rows, VEC)
    assert {r[:3] for r in similarity.cosine_pairs(df, 0.8).collect()} == want == {r[:3] for r in similarity.ann_pairs(df, 0.8, gap=2).collect()}
    assert {r.id for r in similarity.nearest_sims(df).collect()} == {i for _, i in u}


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(100, 32))
    rows = [("a", i, [float(x) for x in base[rng.integers(100)] + 0.2 * rng.normal(size=32)]) for i in range(4000)] + [("a", 9000, None), ("b", 1, [1.0] * 32), ("a", 9001, [0.0] * 32)]
    df = spark.createDataFrame(rows, VEC)
    exact, near = similarity.cosine_pairs(df, 0.9), similarity.ann_pairs(df, 0.9)
    assert similarity.recall(exact, near).first().recall >= 0.99 and near.join(exact, ["part", "a", "b"], "left_anti").count() == 0
    assert similarity.recall(exact.limit(0), near).first().recall == 1.0 and similarity.ann_pairs(df.limit(0), 0.9).count() == 0
    assert {r[:3] for r in similarity.ann_pairs(df, 0.9, block=100).collect()} == {r[:3] for r in near.collect()}
    c = similarity.candidates(df).first()
    assert c.looked < 0.5 * c.every


def test_recall_by_lists_is_that_of_the_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(p, i, [float(x) for x in base[rng.integers(60)] + 0.25 * rng.normal(size=16)]) for p in "ab" for i in range(1500)]
    rows += [("a", 8000 + i, [float(x) for x in rng.normal(size=5)]) for i in range(40)] + [("a", 9000, None), ("a", 9001, [0.0] * 16), ("c", 1, [1.0] * 16)]
    rows += [("d", 1, [1.0] + [0.0] * 15), ("d", 2, [0.6, 0.8] + [0.0] * 14), ("d", 3, [0.6 - 1e-7, 0.8] + [0.0] * 14)]  # of 0.6 and a little less
    df = spark.createDataFrame(rows, VEC)
    for least, gap in ((0.8, 0.0), (0.8, 0.05), (0.6, 0.2)):
        exact = similarity.cosine_pairs(df, least)
        want, n = similarity.recall(exact, similarity.ann_pairs(df, least, gap)).first().recall, exact.count()
        for block in (700, 1 << 22):
            got = similarity.recall_by_lists(df, least, gap, block=block).first()
            assert got.pairs == n and got.recall == want == got.found / n
            assert (got.looked, got.every) == tuple(similarity.candidates(df, gap).first())
        assert gap or want < 0.95
    none = similarity.recall_by_lists(df.limit(0), 0.9).first()
    assert (none.pairs, none.found, none.recall) == (0, 0, 1.0)


def test_recall_query_writes_no_pairs(spark, tmp_path):
    """8,000 rows with some 3 million similar pairs: what is shuffled is the rows, a few times, not the pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(10, 64))
    rows = [("r", i, 1, "m", [float(x) for x in base[i % 10] + 0.1 * rng.normal(size=64)]) for i in range(8000)]
    spark.createDataFrame(rows, "run_id string, url_id long, fetched_at long, embedding_model string, embedding array<float>").withColumn("loaded_at", F.lit(0)).write.parquet(f"{tmp_path}/analysis_rows.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = analysis_queries.sim_ann_recall(spark, str(tmp_path)).first()
    assert got.recall > 0.99 and 0 < got.looked_at < 1
    assert written() - before < 15 * 8000 * 64 * 4


def test_complete_linkage_of_components_beyond_a_task(spark):
    df = spark.createDataFrame(vectors(60, 4, 5, ("a", "b")), VEC)
    pairs = similarity.cosine_pairs(df, 0.6)
    some = pairs.where("(a + b) % 7 <> 0")  # similar but no link
    for p in (pairs, some):
        want, got = (sorted(map(tuple, similarity.complete_linkage(p, df, 0.6, **k).collect())) for k in ({}, {"in_task": 5}))
        assert want and got == want
    assert inspect.signature(similarity.complete_linkage).parameters["most"].default is None  # no component is refused unasked


def test_linkage_and_cohesion(spark):
    rows = vectors(40, 8, 3, ("a",))
    u = unit(rows)
    df = spark.createDataFrame(rows, VEC)
    pairs = similarity.cosine_pairs(df, 0.85)
    groups = {}
    for r in similarity.complete_linkage(pairs, df, 0.85).collect():
        groups.setdefault(r.cluster, []).append(r.id)
    assert groups and all(u["a", i] @ u["a", j] >= 0.85 - 1e-9 for g in groups.values() for i in g for j in g if i < j) and all(c == min(g) for c, g in groups.items())
    with pytest.raises(ValueError):
        similarity.complete_linkage(pairs, df, 0.85, most=1)
    single = similarity.single_linkage(pairs)
    for r in similarity.cluster_cohesion(single, df, 3).collect():
        ids = [x.id for x in single.where(F.col("cluster") == r.cluster).collect()]
        sims = [u["a", i] @ u["a", j] for i in ids for j in ids if i < j]
        assert r["size"] == len(ids) and abs(r.min_sim - min(sims)) < 1e-6 and abs(r.mean_sim - np.mean(sims)) < 1e-6
        break


def test_centroid_and_projection(spark):
    rows = vectors(50, 6, 4, ("a",))
    u = np.stack(list(unit(rows).values()))
    df = spark.createDataFrame(rows, VEC)
    c = u.mean(0)
    got = {r.id: r.sim for r in similarity.centroid_sims(df).collect()}
    assert all(abs(got[i] - u[i] @ c / np.linalg.norm(c)) < 1e-6 for i in range(50))
    xy = np.array([[r.x, r.y] for r in similarity.projection(df).orderBy("id").collect()])
    s = np.linalg.svd(u - c, compute_uv=False)[:2]
    assert np.allclose(np.linalg.norm(xy, axis=0), s, atol=1e-3)


PAGE = "run_id string, url_id long, url string, vector array<float>, hreflang_group string, hreflang_code string, word_count int, signal_confidence string, signature_model_input string"


def test_risks_and_clusters(spark):
    rich, thin = "w " * 100, "w"
    rows = [
        ("r", 1, "https://h/a", [1.0, 0.0], None, "en", 500, "high", rich), ("r", 2, "https://h/a/b", [1.0, 0.01], None, "en", 900, "low", rich), ("r", 3, "https://h/news/x", [0.0, 1.0], None, "en", 10, "high", rich), ("r", 4, "https://h/news/y", [0.01, 1.0], None, "en", 10, "high", rich),
        ("r", 5, "https://h/c", [-1.0, 0.0], None, "en", 3, "high", thin), ("r", 6, "https://h/d", [-1.0, 0.01], None, "en", 3, "high", thin), ("r", 7, "https://h/e", [0.0, -1.0], "H1", "en", 3, "high", rich), ("r", 8, "https://h/f", [0.01, -1.0], "H1", "en-GB", 3, "high", rich), ("r", 9, "https://h/g", [1.0, 0.0], None, "de", 3, "high", rich), ("r", 10, "https://h/z", None, None, "en", 1, None, None),
    ]
    pages = overlap.prepared(spark.createDataFrame(rows, PAGE))
    pairs = overlap.overlap_pairs(pages, sections=["news"])
    assert {(r.a, r.b, r.relation, r.thin, r.pair_class, r.low_confidence) for r in pairs.collect()} == {(1, 2, "parent-child", "", "", True), (3, 4, "sibling", "", "time-sequenced", False), (5, 6, "cross-section", "both", "", False)}
    risk = {r.id: r.risk for r in overlap.page_risks(pages, pairs).collect()}
    assert risk == {1: overlap.PARENT_CHILD, 2: overlap.PARENT_CHILD, 3: overlap.SEQUENCED, 4: overlap.SEQUENCED, 5: overlap.THIN, 6: overlap.THIN, 7: "", 8: "", 9: ""}
    rows = {r.cluster: r for r in overlap.cluster_rows(pages, pairs, overlap.clusters(pages, pairs), sections=["news"]).collect()}
    assert rows[1].suggested_canonical == "https://h/a" and rows[3].suggested_canonical.startswith("review — time-sequenced section (/news)") and rows[5].thin and rows[1].avg_word_count == 700
    assert {r.cluster_id for r in overlap.named_clusters(overlap.clusters(pages, pairs)).collect()} == {"C0000", "C0001", "C0002"}
    assert overlap.primary_only(spark.createDataFrame([("r", 1, "https://h/long", "H", "en"), ("r", 2, "https://h/s", "H", "de"), ("r", 3, "https://h/n", None, "de")], "run_id string, url_id long, url string, hreflang_group string, hreflang_code string")).count() == 2


def test_labels_of_clusters(spark):
    m = spark.createDataFrame([("p", 1, 1, "https://h/a/b/c", "oak bench rain"), ("p", 2, 1, "https://h/a/b/d", "oak bench lamp"), ("p", 3, 1, "https://h/a/b", "oak lamp")], "part string, id long, cluster long, url string, t string")
    assert overlap.distinguishing_terms(m, "t").first().terms == "bench, lamp, rain" and overlap.shared_prefix(m).first().prefix == "/a/b"


def side(spark, rows):
    return spark.createDataFrame(rows, "requested_url string, final_url string, fetched_at long, sha256 string, simhash long, title string, h1 string, meta_description string, word_count int, schema_types array<string>")


def test_compare_runs(spark):
    a = side(spark, [("https://o/", "https://o/", 1, "x", 1, "T", "h", None, 5, ["A"]), ("https://o/gone", "https://o/gone", 1, "g", 1, None, None, None, 1, None), ("https://o/old", "https://o/new", 1, "n", 7, "N", None, None, 2, None), ("https://o/twice", "https://o/twice", 1, "p", 1, "first", None, None, 1, None), ("https://o/twice", "https://o/twice", 2, "q", 1, "last", None, None, 1, None)])
    b = side(spark, [("https://n/", "https://n/", 1, "y", 3, "T2", "h", None, 5, ["B"]), ("https://n/new", "https://n/new", 1, "n", 7, "N", None, None, 2, None), ("https://n/fresh", "https://n/fresh", 1, None, None, None, None, None, None, None), ("https://n/twice", "https://n/twice", 1, None, None, "last", None, None, 1, None)])
    rows = {r.path: r for r in compare.compare_runs(a, b, [("https://o", "https://n")]).collect()}
    assert rows["/"].content_verdict == "near" and rows["/"].baseline_title == "T" and rows["/"].baseline_h1 is None and rows["/"].candidate_schema_types == ["B"]
    assert rows["/gone"].content_verdict == "missing" == rows["/fresh"].content_verdict and rows["/new"].content_verdict == "identical" and rows["/twice"].content_verdict == "unknown"
    assert rows["/old"].is_moved_content and rows["/old"].redirect_chain == "/old -> /new" and not rows["/old"].exists_on_baseline
    assert compare.compare_runs(a.limit(0), b.limit(0)).count() == 0


def test_links_renders_and_pairs(spark):
    la = spark.createDataFrame([("/", "https://o/a", "A"), ("/", "https://o/b", None), ("/x", "https://o/a", "A")], "path string, href string, anchor_text string")
    lb = spark.createDataFrame([("/", "https://n/a", "A"), ("/", "https://n/c", "C")], "path string, href string, anchor_text string")
    got = {(r.path, r.change, r.href) for r in compare.link_changes(la, lb, [("https://o", "https://n")]).collect()}
    assert got == {("/", "removed", "https://n/b"), ("/", "added", "https://n/c")}
    r = "url string, title string, description string, canonical string, size int, links array<string>"
    a = spark.createDataFrame([("1", " T", None, None, 100, []), ("2", "x", None, None, 100, []), ("3", "x", None, None, 100, []), ("4", "x", None, None, 0, ["https://h/a"])], r)
    b = spark.createDataFrame([("1", "t", None, None, 110, []), ("2", "y", None, None, 100, []), ("3", "x", None, None, 100, [f"https://h/n/{i}" for i in range(6)]), ("4", "x", None, None, 9, [])], r)
    assert {x.url: x.verdict for x in compare.compare_renders(a, b).collect()} == {"1": "ok", "2": "meta_drift", "3": "nav_js_injected", "4": "ok"}
    rows = spark.createDataFrame([(2, " a ", "b", "n"), (3, "a", "c", None), (4, "", "x", None), (5, "d", None, None)], "line long, source_url string, target_url string, note string")
    pairs, skipped = compare.first_pairs(rows)
    assert [tuple(x) for x in pairs.collect()] == [("a", "b", "n")] and {x.reason for x in skipped.collect()} == {"duplicate source a", "empty source", "empty target for d"}
    with pytest.raises(ValueError):
        compare.failing(pairs, "nothing")


def test_reports(spark):
    p = spark.createDataFrame([("r", 1, "https://h/a", "html", 200, True, ["https://h/a"], 3.0), ("r", 2, "http://h/b", "html", 404, None, ["https://h/x"], None), ("r", 3, "https://h/c", "pdf", 200, None, None, 9.0)], "run_id string, url_id long, url string, kind string, final_status_code int, overall_indexable boolean, canonical_urls array<string>, total_duration_seconds double")
    assert [r.url for r in reports.sitemap_pages(p).collect()] == ["https://h/a"]
    wide = p.select("*", *(F.lit(None).cast("string").alias(c) for c in ("title", "meta_description", "h1_tags")), F.lit(0.1).alias("ttfb_seconds"))
    got = {r.label: (r.n, r.pct) for r in reports.overview(wide).collect()}
    assert got["total"] == (3, 100.0) and got["indexable"] == (1, 33.3) and got["c4xx"] == (1, 33.3) and got["missing_title"] == (2, 66.7)
    assert [r.url for r in reports.slowest(wide).collect()] == ["https://h/c", "https://h/a"]
    links = spark.createDataFrame([("r", 1, None), ("r", 2, 1), ("r", 2, 1)], "run_id string, url_id long, parent_id long")
    assert [r.url for r in reports.orphan_pages(p, links).collect()] == ["https://h/a"] and reports.hub_pages(links, 2).first().outlinks == 2
    assert reports.one_run(p).count() == 3
    with pytest.raises(ValueError):
        reports.one_run(p.limit(0))
    with pytest.raises(ValueError):
        reports.one_run(p.unionByName(p.withColumn("run_id", F.lit("s"))))


def test_identity(spark):
    e = spark.createDataFrame([("https://h/A", "https://h/b/", "de"), ("https://h/b", "https://h/c", "x-default"), ("https://h/c", "https://h/b", None), ("https://h/z", "https://h/z", "en"), (None, "x", None)], "url string, alt_url string, code string")
    got = {r.norm_url: (r.hreflang_group, r.declared) for r in identity.hreflang_groups(e).collect()}
    assert got == {"https://h/a": ("H0000", None), "https://h/b": ("H0000", "de"), "https://h/c": ("H0000", None)}
    assert [r.url for r in identity.reciprocity_issues(e).collect()] == ["https://h/A"]
    p = spark.createDataFrame([(1, "https://h/foo/amp", "https://www.h/foo/", "s1"), (2, "https://h/foo", None, "s2"), (3, "https://h/bar?amp=1", None, "s3"), (4, "https://h/bar", None, "s3"), (5, "https://h/amp", None, "s9"), (6, "https://h/q/amp", None, None)], "url_id long, url string, canonical_url string, signature_hash string")
    named = spark.createDataFrame([(6, "https://h/base")], "url_id long, base_url string")
    out = {r.url_id: (r.base_url, r.confirmed_by, r.issue) for r in identity.amp_twins(p, [], named).collect()}
    assert out == {1: ("https://h/foo", "canonical-to-base", ""), 3: ("https://h/bar", "signature-hash", "missing-canonical"), 6: ("https://h/base", "amphtml-target", "missing-canonical")}


def test_numbers_over_partitions(spark):
    from webloom.operators.ranks import numbered

    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(200)], "k string, v int").repartition(7)
    assert [(r.k, r.n) for r in numbered(df, "k", "n").orderBy("n").collect()] == [(f"k{i:03d}", i) for i in range(200)]
    assert numbered(df.limit(0), "k", "n").count() == 0
