"""Queries over pages whose character references were cut off, against their SQL."""

import html

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from pyspark.sql import functions as F

from leafmill import catalogue
from leafmill.functions import text as X

_CUT = ("R&amp;&amp", "R&amp;&am", "a &quot", "&#39", "&copy;right &copyright", "&lt;b&gt", "&amp;amp", "&amp;lt;")


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    """Pages with headings and paragraphs that end within a reference; the last two chapters differ by one."""
    rows = [(i, "https://a.example/", f"<html><body><h1>{x}</h1><p>{x}</p>and {x}<h1>T&amp;</h1><p>t</p><h1>T&amp</h1><p>u</p></body></html>") for i, x in enumerate(_CUT)]
    folder = tmp_path_factory.mktemp("cut")
    pq.write_table(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["page_id", "url", "html"]), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["html_chapters", "book_summary", "book_json", "plain_heading", "reader_files", "render_books", "safe_names", "text_content"])
def test_cut_references_as_in_sql(spark, pages, name):
    assert compare(catalogue.QUERIES[name](spark, pages), catalogue.ORACLE[name], pages) == ""


def test_functions_still_decode_what_html_decodes(spark):
    frame = spark.createDataFrame([(x,) for x in _CUT], "x string").select("x", X.unescape(F.col("x")).alias("y"))
    assert all(r["y"] == html.unescape(r["x"]) for r in frame.collect())


@pytest.mark.parametrize("name", ["reader_files", "render_books"])
def test_odd_pages_as_in_sql(spark, tmp_path, name):
    """Pages that are null, empty or blank, and titles to be escaped, folded, cut and counted."""
    texts = [None, "", "  ", "<h1></h1>", "<h1>x</h1>", "<h1>\u00c9 \u00df &amp; 'q' \"z\"</h1>a", "<H1 class=a>A<b>b</b></H1>t<h1>ab</h1>u", "<h1>a</h1><img src='https://x/y.png'>t", "<h1>" + "ab " * 40 + "</h1>x", "<h1>1</h1>x<h1>2</h1>y" * 6]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array(["https://a.example/"] * len(texts)), pa.array(texts)]
    pq.write_table(pa.table(columns, names=["page_id", "url", "html"]), tmp_path / "pages.parquet")
    assert compare(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLE[name], str(tmp_path)) == ""
