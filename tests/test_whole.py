"""Queries that must cover whole inputs, on inputs longer than any prefix."""

import pytest

import leafmill.catalogue as catalogue
from leafmill.operators import package
from leafmill.plans.checkpoints import keep


@pytest.fixture
def long_document(spark, tmp_path):
    spark.createDataFrame([(0, "\n".join("a b c d" for _ in range(9)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,rows", [("span_decode", 36), ("inline_markup", 36), ("longest_span", 9)])
def test_spans_of_all_lines(spark, long_document, name, rows):
    got = catalogue.QUERIES[name](spark, long_document)
    assert got.count() == rows and {r["line"] for r in got.select("line").collect()} == set(range(9))


def test_styles_of_late_words_count(spark, tmp_path):
    """Flags are (7 * pos + doc_id) % 32: of document 4 the first word has none of the styles, later ones have."""
    spark.createDataFrame([(4, "a"), (36, "a\nb\nc\nd"), (68, "a b c d e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["styled"] for r in catalogue.QUERIES["styled_pages"](spark, str(tmp_path)).collect()}
    assert got == {4: False, 36: False, 68: True}


def test_chains_to_their_end_and_once_round_circles(spark):
    """Item 0 leads to 21; 100 to 103 are a circle with the tail 99; only 21 is supported."""
    rows = [(i, i + 1 if i < 21 else None) for i in range(22)] + [(99, 100), (100, 101), (101, 102), (102, 103), (103, 100), (200, 999)]
    items = spark.createDataFrame(rows, "item_id long, fallback long").selectExpr("*", "if(item_id = 21, 'ok', 'no') AS media_type")
    chain = package.whole_chains(items, items, keep)
    got = {}
    for r in chain.orderBy("root", "hop").collect():
        got.setdefault(r["root"], []).append((r["hop"], r["item_id"]))
    want = {i: list(enumerate(range(i, 22))) for i in range(22)} | {200: [(0, 200)]}
    want |= {99: list(enumerate([99, 100, 101, 102, 103]))} | {100 + i: list(enumerate(100 + (i + j) % 4 for j in range(4))) for i in range(4)}
    assert got == want
    assert {r["item_id"] for r in package.without_supported(chain, items, ["ok"]).collect()} == {99, 100, 101, 102, 103, 200}
    with pytest.raises(RuntimeError, match="steps"):
        package.whole_chains(items, items, keep, most_steps=100)


def test_navigation_of_all_items_is_counted(spark, tmp_path):
    spark.range(1, 1001).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["nav_cardinality"](spark, str(tmp_path)).collect()
    assert len(got) == 201 and sum(r["n_toc"] + r["n_pages"] + r["n_landmarks"] for r in got) == 750
    assert {r["ok"] for r in got} == {True, False}


def test_references_of_all_blocks_of_a_page(spark, tmp_path):
    html = "<style>a{background:url(1.png)}</style><STYLE media='all'>b{background:url(2.png)}</STYLE ><styled>c{background:url(3.png)}</styled>"
    html += "<script>fetch('/1')</script><script type=\"module\" async>fetch('/2')</script>"
    spark.createDataFrame([(2, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    refs = {name: {r["ref"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("css_refs", "js_refs")}
    assert {"1.png", "2.png"} <= refs["css_refs"] and "3.png" not in refs["css_refs"] and {"/1", "/2"} <= refs["js_refs"]


def test_rectangles_of_all_lines(spark, long_document):
    assert {r["rect"] for r in catalogue.QUERIES["rect_overlap"](spark, long_document).collect()} == set(range(9))
