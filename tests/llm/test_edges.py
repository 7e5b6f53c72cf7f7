"""Empty tables, nulls, repeated rows and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import components, decontaminate, embeddings, language, neardup, pii, quotes, substrings, toxicity, urlfilter

DOCS = "doc_id long, text string, n long, node long, component string, lo int, tag int, host string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "c", 3, 4, "h") for i, t in rows], DOCS)


def test_empty_tables(spark):
    docs = documents(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert neardup.near_duplicates(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0
    assert pii.detect(docs, pii.Boosted([], 0.0, {})).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), urlfilter.op9_rules(spark)).count() == 0
    model = language.fit(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert language.identify(docs, model).count() == 0
    chain = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, text string, toxic int"), {"toxic": F.col("toxic")})
    assert toxicity.classify(docs, chain).count() == 0
    full = documents(spark, [(1, "some words here")])
    assert decontaminate.decontaminate(full, items).first()["decon_items"] == []
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), urlfilter.op9_rules(spark).limit(0)).first()["verdict"] == "allow"


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (5, text), (3, text), (3, text), (7, None), (None, None), (None, "alone here"), (9, "")]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(None, 4): (3, False), (5, 4): (3, False), (3, 4): (3, True), (7, 0): (7, True), (None, 0): (None, True), (None, 1): (None, True), (9, 0): (9, True)}


def test_repeats_with_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (4, long), (4, long), (6, "x " + long + " y"), (6, "short"), (8, None)]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(documents(spark, rows)).collect()))
    assert got == [(0, 60, 0, long), (4, 60, 0, long), (4, 60, 0, long), (6, 1, 0, "short"), (6, 62, 60, "x y"), (8, 0, 0, "")]


def test_factors_name_their_reference_and_break_at_edges(spark):
    a, b = [f"a{i}" for i in range(55)], [f"b{i}" for i in range(55)]
    rows = [(1, " ".join(a)), (2, " ".join(["y", *b])), (3, " ".join(["z", *a, *b]))]
    found = substrings.repeated_factors(documents(spark, rows)).where("doc_id = 3").first()["factors"]
    assert [(f["start"], f["length"], f["ref"], f["place"]) for f in found] == [(1, 55, 1, 0), (56, 55, 2, 1)]


def test_passages_over_the_ends_of_factors_are_found(spark):
    """A text whose passages of two references overlap: the second begins inside the first one's factor."""
    w = [f"w{i}" for i in range(130)]
    rows = [(1, " ".join(w[:80])), (2, " ".join(w[60:])), (3, " ".join([*w, *w[10:70]]))]
    found = substrings.repeated_factors(documents(spark, rows)).where("doc_id = 3").first()["factors"]
    assert [(f["start"], f["length"], f["ref"], f["place"]) for f in found] == [(0, 80, 1, 0), (60, 70, 2, 0), (130, 60, 1, 10)]


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [1.0]), (4, [0.0, 1.0]), (5, [])]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.99999).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out)
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]


def test_quotes_with_nulls_and_long_threads(spark):
    rows = [(1, t, f"> line {t - 1}\nline {t}") for t in range(40)] + [(None, 1, "x"), (1, None, "> line 0"), (1, 3, "> line 2\nline 3")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert got[1, 39]["position"] == 39 and got[1, 39]["thread_turn"] == 0 and got[1, 3]["parent_turn"] == 2
    assert got[None, 1]["thread_turn"] == 1 and got[1, None]["thread_turn"] is None and out.count() == len(rows)


def test_quotes_of_very_long_texts(spark):
    rows = [(1, 0, "\n" * 100_000 + "said" + "\n \t" * 100_000), (1, 1, ">" * 100_000 + " said"), (1, 2, "> " * 50_000 + "\n" + "> said\n" * 20_000), (1, 3, "x" * 1_000_000)]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).orderBy("turn").collect()
    assert out[0]["said"] == "said" and out[1]["quote_depth"] == 100_000 and out[1]["parent_turn"] == 0 and out[2]["parent_turn"] == 0


def test_internal_names_as_extra_columns(spark):
    more = ["_c", "_t", "_x", "_in", "_lines", "_p", "_own", "best", "_host", "_after", "_l", "_base", "_cand", "_e", "lines", "pii_base", "full", "short", "digest", "h", "p"]
    base = spark.createDataFrame([(1, 0, "a.b@c.de", "http://net/x"), (1, 1, "> a.b@c.de", None)], "conv_id long, turn long, text string, url string")
    for name in more:
        base = base.withColumn(name, F.lit(f"own {name}"))
    for out in (quotes.link_quotes(base), urlfilter.judge(base, urlfilter.op9_rules(spark)), pii.redact(base, pii.Boosted([], -9.0, {})), pii.detect(base.drop("pii_base"), pii.Boosted([], -9.0, {}))):
        got = out.collect()
        assert len(got) == 2 and all(r[name] == f"own {name}" for r in got for name in more if name != "pii_base" or "pii_spans" not in out.columns)
    with pytest.raises(ValueError):
        pii.detect(base, pii.Boosted([], -9.0, {}))


def test_longest_rule_wins_whatever_its_shape(spark):
    rules = spark.createDataFrame([("a.com", "/x", "block"), ("com", "/", "allow"), ("a.com", "/x/y/", "allow"), ("a.com", "/x", "allow"), (None, "/", "block"), ("", "", "block")], "host string, path string, verdict string")
    urls = ["http://b.a.com/xz", "http://a.com/x/y/z", "http://c.com/q", "http://a.org/", None]
    out = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    assert [(r["rule"], r["verdict"]) for r in out.orderBy("page_id").collect()] == [("a.com/x", "block"), ("a.com/x/y/", "allow"), ("com/", "allow"), (None, "allow"), ("", "block")]


def test_taken_names_are_refused(spark):
    docs = documents(spark, [(1, "x")])
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs.withColumn("decon_items", F.lit(1)), docs.select(F.col("doc_id").alias("item_id"), "text"))
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("lang_pred", F.lit("x")), language.LanguageModel([], []))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
