from pyspark.sql import functions as F

from webloom.llm import languages, residue

PROSE = [
    "The workshop calendar lists the opening hours of the depot for the third week in a row, and the editor on duty says that it is right for most readers.",
    "On day 12 the redirect map was checked against the links in the side column. A visitor asked for the terms that apply to schools and was sent to the desk.",
    "Die Werkstatt beschreibt eine kurze Liste der Werkstoffe, und das Kundenkonto zeigt die Hinweise zur Pflege für den größten Teil des Sortiments ohne jede Ankündigung.",
    "La liste des prix contient les questions les plus fréquentes, et le compte client explique une courte liste de matériaux pour la plus grande partie du catalogue.",
] * 6
LANGS = {
    "en": [t for t in PROSE if t.startswith(("The", "On"))], "de": [t for t in PROSE if t.startswith("Die")], "fr": [t for t in PROSE if t.startswith("La")],
    "ja": ["編集部は二つ目の見出しの下で棚の寸法をまとめています。注文フォームは手引きのとおりに用紙を含んでいます。"] * 3,
}


def test_residue_model():
    m = residue.fit([*PROSE, "{{ title }} <%= price %>"], ["this shelf is empty"])
    bad = ["{{ title }}\n[[price]]", "lorem ipsum dolor sit amet, dolor ipsum elit", "Page not found.", "404 Not Found", "asdf sdfg asdf dfgh", "This shelf is empty"]
    good = [*PROSE[:4], "Write {{ title }} in the template. " + PROSE[0] + PROSE[1], "The page says: page not found. " + PROSE[0] + PROSE[1] + PROSE[1]]
    assert (m.coverage(bad) >= residue.COVER).all() and (m.coverage(good) < residue.COVER).all()
    assert len(m.coverage([])) == 0 and residue.fit([], []).coverage(["", "page not found"])[1] > 0.5


def test_residue_is_learned_from_hosts(spark):
    """Wording no seed holds: repeated on three hosts, said under a notice's title, or beside either."""
    rows = [(f"h{k % 9}", f"Title {k}", " ".join(PROSE[k : k + 3])) for k in range(20)]
    rows += [(f"h{k}", "", "Dieser Regalplatz wurde geräumt.") for k in range(3)]
    rows += [("h4", "Vacant 12", "Our shed keeps no barrow under that label. Ask the yard keeper for another barrow.")]
    rows += [("h5", "", "Our shed keeps no barrow. Dieser Regalplatz wurde geräumt.")]
    df = spark.createDataFrame(rows, "host string, title string, text string")
    m = residue.fit_on(df, spark.createDataFrame([("vacant 7",), (None,)], "title string"))
    bad = ["Ask the yard keeper for another barrow.", "Dieser Regalplatz wurde geräumt.", "Our shed keeps no barrow. Dieser Regalplatz wurde geräumt."]
    assert (m.coverage(bad) >= residue.COVER).all() and (m.coverage(PROSE[:4]) < residue.COVER).all()


def test_dummy_text_of_other_words():
    """Words of the public passages' kind, hardly any of which they hold."""
    odd = [f"Consetur magnibus doloret ipsumque veniatur, laborem quisquat nostrudit aliquamet {w}." for w in ("tempus", "eiusdem", "fugitat", "nullam")]
    assert (residue.fit(PROSE * 4 + odd, []).coverage(odd) >= residue.COVER).all()


def test_residue_queries(spark):
    m = residue.fit(PROSE, [])
    df = spark.createDataFrame([(1, PROSE[0] + "\nPage not found."), (2, "Page not found."), (3, None), (4, "  "), (None, "x"), (2, "Page not found."), (5, PROSE[1] * 3000)], "id long, text string").withColumn("coverage", F.lit("clash"))
    assert sorted(r.id for r in residue.residue_coverage(df, m).collect() if r.coverage >= residue.COVER) == [2, 2]
    assert {(r.id, r.line_no) for r in residue.residue_lines(df, m).collect()} == {(1, 2), (2, 1)}
    assert residue.residue_coverage(df.limit(0), m).count() == 0
    none = spark.createDataFrame([], "host string, title string, text string, extra int")
    assert residue.fit_on(none).coverage(["page not found"])[0] > 0.5
    odd = spark.createDataFrame([(None, None, None), (None, None, " "), ("h", None, "word " * 30_000), ("h", None, "word " * 30_000)], "host string, title string, text string")
    assert residue.fit_on(odd, odd.select("title")).coverage(["page not found"])[0] > 0.5


def test_codes_and_numbers_are_one():
    assert residue.plain("Ray 4qi8fgtw6, (5jhz0) on 12\u00a0May") == "ray 0, (0) on 0 may"


def test_titles_of_notices(spark):
    probes = spark.createDataFrame([("Nothing here",), ("Start  page",), (None,)], "title string")
    pages = spark.createDataFrame([("start page", "word " * 80), ("nothing here", "short"), (None, None)], "title string, text string")
    assert [r.title for r in residue.notice_titles(probes, pages).collect()] == ["Nothing here"]


def test_languages(spark):
    m = languages.fit(LANGS)
    mixed = PROSE[0] + "\n\n" + PROSE[2] + "\n" + PROSE[1]
    df = spark.createDataFrame([(1, mixed), (2, LANGS["ja"][0] + "\nTalmo"), (3, None), (4, " "), (5, "123 456"), (6, PROSE[3]), (6, PROSE[3]), (None, "x")], "id long, text string").withColumn("lang", F.lit("clash"))
    got = [(r.id, r.line_no, r.lang) for r in languages.languages_of(df, m).collect()]
    assert sorted(got) == [(1, 0, "en"), (1, 3, "de"), (2, 0, "ja"), (6, 0, "fr"), (6, 0, "fr")]
    assert all(0 <= r.confidence <= 1 for r in languages.languages_of(df, m).collect())
    assert languages.languages_of(df.limit(0), m).count() == 0 == languages.languages_of(df, languages.fit({})).count()


def test_wrong_labels_are_left_out(spark):
    wrong = {k: [*v] for k, v in LANGS.items()}
    wrong["fr"] += LANGS["de"][:2]
    total, lines, _ = languages.fit(wrong).label([PROSE[2]])[0]
    assert lines == [(1, 0)]
    rows = [(i, t, k) for k, ts in wrong.items() for i, t in enumerate(ts)] + [(9, None, "fr"), (9, "x", None)]
    labelled = spark.createDataFrame(rows, "id long, text string, code string")
    assert languages.fit_on(labelled).languages == ["de", "en", "fr", "ja"]
    assert languages.fit_on(labelled, most=2).languages == ["en", "fr"]  # the most frequent ones


def test_short_foreign_lines(spark):
    m = languages.fit(LANGS)
    df = spark.createDataFrame([(1, PROSE[0] + "\nund nicht\nTalmo\n" + PROSE[1])], "id long, text string")
    assert [(r.line_no, r.lang) for r in languages.languages_of(df, m).collect()] in ([(0, "en"), (2, "de")], [(0, "en")])


def test_code_of(spark):
    rows = spark.createDataFrame([(" EN_us",), ("xx",), ("und",), ("",), (None,), ("pt-BR",)], "x string").select(languages.code_of(F.col("x")).alias("c")).collect()
    assert [r.c for r in rows] == ["en", None, None, None, None, "pt"]
