"""Goldens of operators where order, chance or scale decides."""

import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import scan, unicode
from leafmill.functions import text as X
from leafmill.functions import urls as U
from leafmill.operators import layout, package, pages, reports, review
from leafmill.operators.chapters import html_chapters
from leafmill.plans.checkpoints import keep


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_sanitise_removes_in_order_and_is_idempotent(spark):
    html = "<p onclick='a()'>x</p><SCRIPT>b</SCRIPT><iframe src=c><a href=\" javascript:d\">e</a><img alt='' src='http://f/g.png'>"
    got = one(spark, html, X.sanitize)
    assert got["clean"] == "<p>x</p><a>e</a>"
    assert (got["active"], got["attributes"], got["images"]) == (2, 2, 1)
    assert one(spark, got["clean"], X.sanitize)["clean"] == got["clean"]


def test_chapters_merge_drop_and_fall_back(spark):
    rows = [(1, "<body>pre<h1>A</h1>x<h1>a</h1>y<h1>Empty</h1> <h1> </h1>z</body>"), (2, "<p>no heading</p>"), (3, "<h1>Only</h1>")]
    got = html_chapters(spark.createDataFrame(rows, "id int, h string"), "id", "h", F.lit("Book")).orderBy("id", "chapter_index").collect()
    assert [(r["id"], r["title"], r["html"]) for r in got] == [(1, "Book", "pre"), (1, "A", "x\ny"), (1, "Book", "z"), (2, "Book", "<p>no heading</p>"), (3, "Book", "<h1>Only</h1>")]


def test_normalised_text_is_stable(spark):
    once = one(spark, "<p>a</p>b<br/>c  d &amp; e", X.text_content)
    assert once == "a b c d & e"


@pytest.mark.parametrize("path,want", [("/a/./b/../c", "/a/c"), ("/..", "/"), ("", "/"), ("/a/b/..", "/a/"), ("/a/", "/a/")])
def test_dot_segments(spark, path, want):
    assert one(spark, path, U.remove_dot_segments) == want


def test_remote_key_drops_default_port_and_fragment(spark):
    assert one(spark, "HTTP://User@Example.COM.:80/a/../b?q#f", U.remote_key) == "http://User@example.com/b?q"


@pytest.mark.parametrize("ref,want", [("x.png", "http://h/a/x.png"), ("../x", "http://h/x"), ("//g/y", "http://g/y"), ("?q", "http://h/a/b?q"), ("/r", "http://h/r")])
def test_resolve(spark, ref, want):
    assert one(spark, ref, lambda x: U.resolve(F.lit("http://h/a/b"), x)) == want


def test_absorbed_single_paragraph_pages_alternate(spark):
    long = "lower " * 30 + "end"
    rows = [(1, p, 0, long) for p in range(1, 6)]
    got = pages.join_pages(spark.createDataFrame(rows, "doc_id int, page int, pos int, block string")).orderBy("page").collect()
    assert [r["joined"] for r in got] == [True, False, True, False, False]


def test_bands_follow_the_first_line_not_the_last(spark):
    rows = [(1, y) for y in (0.0, 2.0, 4.0, 6.0)]
    got = layout.bands(spark.createDataFrame(rows, "doc_id int, baseline double"), 2.5).orderBy("band").collect()
    assert [r["n"] for r in got] == [2, 2]


@pytest.mark.parametrize("scale", [0.5, 1.0, 2.0])
def test_reflow_does_not_depend_on_scale(spark, scale):
    rows = [(1, i, t, (50 + 12 * i) * scale, 40 * scale, r * scale, 10 * scale, False) for i, (t, r) in enumerate([("a", 350), ("b", 350), ("c", 100), ("d", 350), ("1. e", 350)])]
    lines = spark.createDataFrame(rows, "doc_id int, pos long, text string, baseline double, left_x double, right_x double, size double, bold boolean")
    assert [r["text"] for r in layout.paragraphs(lines).orderBy("para").collect()] == ["a b c", "d", "1. e"]


def test_later_patches_see_earlier_ones(spark):
    frame = spark.createDataFrame([("one two two",)], "t string")
    patch = lambda o, r, c=0.9: F.struct(F.lit(o).alias("original"), F.lit(r).alias("replacement"), F.lit(c).alias("confidence"))
    got = frame.select(review.apply_patches(F.col("t"), F.array(patch("two", "2"), patch("one two", "x"), patch("two", "2"), patch("x", "y", 0.1)), 0.5).alias("r")).first()["r"]
    assert got["text"] == "x 2"
    assert got["verdicts"] == ["occurrence count", "applied", "applied", "confidence"]


def test_long_fallback_chain_and_circle(spark):
    rows = [(i, i + 1 if i < 10_000 else None) for i in range(1, 10_001)] + [(20_001, 20_002), (20_002, 20_003), (20_003, 20_002)]
    got = package.fallback_ends(spark.createDataFrame(rows, "item_id long, fallback long"), keep)
    assert sorted(r["item_id"] for r in got.where("cyclic").collect()) == [20_001, 20_002, 20_003]


def test_css_tokens():
    style = r"""@import 'a.css'; @namespace url(urn:no); p{background:URL( "b\20 c.png" )} /* url(no) */
    q{content:"no.png"; background:-webkit-image-set("d.png" 1x, url(e.png) 2x, "f.png" type("no"))}"""
    assert scan.css_references(style) == ["a.css", "b c.png", "d.png", "e.png", "f.png"]


def test_css_nesting_budget():
    with pytest.raises(scan.BudgetError):
        scan.css_references("f(" * 5000)


@pytest.mark.parametrize(
    "source,want",
    [
        ("import a from 'x.js'", ["x.js"]),
        ("export * from \"y.js\"; import('z' + '.js')", ["y.js", "z.js"]),
        ("const f = fetch, u = 'a'; { const f = g; f('no') } f(u)", ["a"]),
        ("importScripts('a', 'b'); new SharedWorker(`c`)", ["a", "b", "c"]),
        ("self['fetch']('a'); window.fetch?.('b')", ["a"]),
        ("var r = new XMLHttpRequest; r.open('GET', '/x')", ["/x"]),
        ("// fetch('no')\n'fetch(\"no\")'", []),
    ],
)
def test_script_references(source, want):
    assert scan.js_references(source) == want


def test_script_refuses_data_in_browsing_context():
    with pytest.raises(ValueError, match="data URL"):
        scan.js_references("const o = window.open; o.call(window, 'data:text/html,x')")


def test_xml_refuses_entities_and_keeps_order():
    assert [(r[0], r[1], r[4]) for r in scan.xml_rows(b"<a><b/><c>t</c></a>")] == [(0, None, "a"), (1, 0, "b"), (2, 0, "c")]
    with pytest.raises(scan.BudgetError):
        scan.xml_rows(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_legacy_text_needs_enough_markers(spark):
    rows = ["plain text", "¸µ¶¹ a¸", "¸µ¶¹\nTH¸NG <b>ABCD</b> x¸\r\nABC ¸µ¶¹ DE¸", None]
    got = [r["d"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(unicode.legacy_text(F.col("t")).alias("d")).collect()]
    assert tuple(got[0]) == ("plain text", 0) and got[1]["changed"] == 5 and got[1]["text"] == "áàảạ aá"
    assert got[2]["text"] == "áàảạ\nTHÁNG <b>ABCD</b> xá\r\nABC ÁÀẢẠ DEÁ" and got[3]["text"] is None
    assert unicode.restore_case("the Old man", ["old", "The old", "MAN"]) == ("THE OLD man", 1)


def test_footnotes_and_ornaments(spark):
    page = F.array(F.lit("x<sup>1</sup>"), F.lit("* *"), F.lit("*"), F.lit("1.  note"))
    frame = spark.range(1).select(pages.footnotes(page).alias("f"), pages.collapse_ornaments(page).alias("o")).first()
    assert frame["f"]["blocks"][0] == "x[^1]" and frame["f"]["blocks"][3] == "[^1]: note"
    assert frame["o"]["collapsed"] == 1 and len(frame["o"]["blocks"]) == 3


def test_archive_members_and_formats(spark, tmp_path):
    from leafmill.sources.files import ArchiveSource, read_files, read_text

    with zipfile.ZipFile(tmp_path / "a.epub", "w") as archive:
        archive.writestr("mimetype", "application/epub+zip")
        archive.writestr("x.xhtml", "<html/>")
    (tmp_path / "b.txt").write_bytes(b"one\r\n\r\ntwo")
    (tmp_path / "c").write_bytes(b"<!DOCTYPE html>")
    spark.dataSource.register(ArchiveSource)
    assert spark.read.format("archive").load(str(tmp_path)).count() == 2
    got = {r["path"].rpartition("/")[2]: r["format"] for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": "epub", "b.txt": "txt", "c": "html"}
    assert read_text(spark, str(tmp_path / "b.txt")).first()["text"] == "one\n\ntwo"


def test_review_pauses_and_resumes(spark, tmp_path):
    from leafmill.streaming import batches

    rows = [(d, p, f"text {d} {p}") for d in (1, 2) for p in range(1, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, page long, text string")
    frame.write.parquet(str(tmp_path / "pages"))

    def failing(doc: int, batch: int, text: str):
        if doc == 2 and batch == 2:
            raise RuntimeError("no answer")
        return 1, 0, 0.5

    query = batches.review_stream(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "mark"), failing, size=2)
    query.awaitTermination()
    got = batches.stored(spark, str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["batch"], r["status"]) for r in got.collect()) == [(1, 1, "completed"), (1, 2, "completed"), (2, 1, "completed"), (2, 2, "paused")]
    batches.resume(spark, frame, str(tmp_path / "out"), lambda d, b, t: (0, 1, 0.0), size=2)
    got = batches.stored(spark, str(tmp_path / "out"))
    assert got.count() == 5 and got.where("status = 'completed'").count() == 4


def test_navigation_entries(spark):
    rows = spark.createDataFrame([(1, b"<nav><ol><li><a href='x'>  One </a></li></ol><a href='no'>n</a></nav>")], "pkg int, content binary")
    flat = rows.select("pkg", F.inline(scan.xml_flatten(F.col("content"))["rows"]))
    assert [(r["href"], r["label"]) for r in reports.navigation_entries(flat).collect()] == [("x", "One")]


def test_markdown_and_docx_become_markup(tmp_path):
    import io

    from leafmill.sources import markup

    text = "# One *two*\n\nfirst\nline `a<b` ![x](y.png)\n\n- a\n- [b](#c)\n\n1. n\n\n```ts\n<x>\n```\n"
    assert markup.markdown_html(text) == (
        '<h1>One <em>two</em></h1>\n<p>first line <code>a&lt;b</code> <img src="y.png" alt="x" /></p>\n<ul><li>a</li><li><a href="#c">b</a></li></ul>\n<ol><li>n</li></ol>\n<pre><code>&lt;x&gt;</code></pre>'
    )
    data = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:body></w:document>')
    assert markup.docx_html(data.getvalue()) == "<h1>T</h1>\n<p>a &amp; b</p>"


@pytest.mark.parametrize("url,want", [("HTTP://[0:0::1]:80/%7Ea/../b%2f?x y", "http://[::1]/b%2F?x%20y"), ("https://EXAMPLE.com.:444", "https://example.com:444/"), ("http://u:p@h/%zz", "http://u:p@h/%25zz")])
def test_canonical_urls(url, want):
    from leafmill.functions import urls_full

    assert urls_full.canonical(url) == want


def test_alias_closure_and_scopes(spark):
    edges = spark.createDataFrame([(f"a{i}", f"a{i - 1}") for i in range(1, 30)] + [("x", "y"), ("y", "x")], "name string, target string")
    got = package.alias_closure(edges, spark.createDataFrame([("a0",)], "name string"), keep)
    assert got.count() == 30
    uses = spark.createDataFrame([(1, "n", ["g", "f", "b"]), (2, "n", ["g"])], "use int, name string, path array<string>")
    bound = spark.createDataFrame([("g", "n"), ("f", "n")], "scope string, name string")
    assert {r["use"]: r["scope"] for r in package.nearest_bindings(uses, bound).collect()} == {1: "f", 2: "g"}


def test_diff_and_audit(spark):
    frame = spark.createDataFrame([(1, 0, "a\nb\n", "a\nc\n", "b", "c", 0.9, "typo")], "id int, seq int, x string, y string, original string, replacement string, confidence double, reason string")
    assert "-b\n+c\n" in frame.select(reports.unified_diff(F.col("x"), F.col("y")).alias("d")).first()["d"]
    assert reports.audit_table(frame, "id").first()["markup"] == "<tr><td>b</td><td>c</td><td>0.9</td><td>typo</td></tr>"
