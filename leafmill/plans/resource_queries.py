"""Queries over the resources of a package, page events and review records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import resources as S
from ..functions import scan
from ..functions import text as X
from ..operators import layout as L
from ..operators import review as R
from ..operators.chapters import chapters_of
from ..sources import derived as D
from .package_queries import _SAID
from .scan_queries import ORACLE as SCAN_ORACLE
from .text_queries import ORACLE as TEXT_ORACLE
from .text_queries import _IMAGE, s_escape, s_safe, s_sub

QUERIES = {}
ORACLE = {}
HOST = "package.invalid"
_HREF = r"""(?i)href="([^"]*)\""""


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE[function.__name__] = function, sql
        return function

    return add


@query(f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, 0 AS up FROM pages
  UNION ALL SELECT page_id, repeat('../', page_id % 4) || './text//part%20' || page_id || '.xhtml?x#y', page_id % 4 FROM pages)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') OR starts_with(href, '/') OR up = 3 THEN NULL
    ELSE ['OEBPS/pkg/', 'OEBPS/', ''][up + 1] || CASE WHEN contains(href, './text//') THEN 'text/part ' || page_id || '.xhtml' ELSE regexp_extract(href, '^[^?#]*') END END AS path,
  CASE WHEN regexp_matches(href, '^https?://') THEN NULL WHEN starts_with(href, '/') OR up = 3 THEN 'unsafe package resource' END AS problem FROM h""")
def archive_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the pages' links and derived relative ones name."""
    pages = D.load(spark, sf_dir, "pages")
    more = F.concat(F.expr("repeat('../', int(page_id % 4))"), F.lit("./text//part%20"), F.col("page_id"), F.lit(".xhtml?x#y"))
    links = pages.select("page_id", F.explode(F.concat(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), F.array(more))).alias("href"))
    return links.select("page_id", "href", S.archive_reference(F.lit("OEBPS/pkg/content.opf"), F.col("href")).alias("r")).select("page_id", "href", "r.path", "r.problem")


@query(f"SELECT doc_id, 'https://{HOST}/' || replace(url_encode(string_split(text, chr(10))[1] || '/ä*+~.x'), '%2F', '/') AS base FROM documents WHERE text IS NOT NULL")
def resource_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of members that are named by the first lines of documents."""
    path = F.concat(F.split("text", "\n")[0], F.lit("/ä*+~.x"))
    return D.load(spark, sf_dir, "documents").where("text is not null").select("doc_id", S.resource_base(path, HOST).alias("base"))


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://{HOST}/t/' || page_id || '.xhtml' WHEN 1 THEN 'https://{HOST}/t/sub' || page_id || '/' WHEN 2 THEN 'https://b.example/' || page_id
    WHEN 4 THEN 'https://{HOST}/t/' || page_id || '.xhtml' END AS base, CASE WHEN page_id % 5 = 3 THEN 'file URLs are forbidden' END AS problem FROM pages""")
def document_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base URLs of derived documents: none, relative, absolute, forbidden, and one outside of the head."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    href = F.when(k == 1, F.concat(F.lit("sub"), i, F.lit("/"))).when(k == 2, F.concat(F.lit("https://b.example/"), i)).otherwise("file:///x")
    base = F.concat(F.lit('<base href=" "/><base href="'), href, F.lit('"/><base href="other"/>'))
    text = F.concat(
        F.lit(f'<html xmlns="{S.XHTML}"><head><title/>'), F.when(k.isin(1, 2, 3), base).otherwise(""), F.lit("</head><body>"), F.when(k == 4, '<base href="late/"/>').otherwise(""), F.lit("</body></html>")
    )
    rows = D.load(spark, sf_dir, "pages").select("page_id", scan.xml_flatten(F.encode(text, "UTF-8"))["rows"].alias("rows"))
    found = S.document_base(F.col("rows"), F.concat(F.lit("t/"), i, F.lit(".xhtml")), HOST)
    return rows.select("page_id", found.alias("b")).select("page_id", "b.base", "b.problem")


@query(f"""WITH {D.MARKED_PAGES} SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS ord, unnest(a) AS src FROM (SELECT page_id, regexp_extract_all(html, '(?i)src="([^"]*)"', 1) AS a FROM marked)""")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in pages, in order."""
    return D.marked_pages(spark, sf_dir).select("page_id", F.posexplode(S.image_sources(F.col("html"))).alias("ord", "src")).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {D.MARKED_PAGES} SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, '(?i)src="([^"]*)"', 1), regexp_extract_all(html, '{_HREF}', 1)))), ' ') AS names FROM marked""")
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and targets of pages, each once, in ascending order."""
    both = F.concat(S.image_sources(F.col("html")), F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    return D.marked_pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(F.array_distinct(both)), " ").alias("names"))


_STYLE = "body{max-width:42em;margin:auto}"


@query(f"SELECT page_id, sha256(replace(html, '</head>', '<style>{_STYLE}</style></head>')) AS preview_sha FROM pages")
def preview_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a style sheet put in their heads."""
    return D.load(spark, sf_dir, "pages").select("page_id", F.sha2(S.with_style(F.col("html"), _STYLE), 256).alias("preview_sha"))


_TYPES = (" Text/JavaScript ", "text/javascript; charset=utf-8", "module", "application/json", "", "text/livescript", "importmap")
_RELATIONS = ("Icon shortcut", "alternate", " next  PRELOAD", "stylesheet", "", "author")


@query(f"""WITH t AS (SELECT page_id, {list(_TYPES)!r}[page_id % 7 + 1] AS type, page_id % 2 = 0 AS svg, {list(_RELATIONS)!r}[page_id % 6 + 1] AS rel FROM pages)
SELECT page_id, CASE WHEN svg THEN trim(split_part(lower(trim(type)), ';', 1)) ELSE lower(trim(type)) END IN ('', 'module', {', '.join(repr(t) for t in S.SCRIPT_TYPES)}) AS runs,
  regexp_matches(lower(rel), '\\b(?:{'|'.join(S.FETCHING_RELATIONS)})\\b') AS fetches FROM t""")
def script_and_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which script types run, in SVG or not, and which link relations fetch."""
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    return D.load(spark, sf_dir, "pages").select("page_id", S.runs(at(_TYPES), F.col("page_id") % 2 == 0).alias("runs"), S.fetches(at(_RELATIONS)).alias("fetches"))


@query(f"WITH {D.ITEMS} SELECT item_id, media_type FROM items WHERE media_type IN ('text/css', {', '.join(repr(t) for t in (*S.SCRIPT_TYPES, *S.XML_TYPES))})")
def referring_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose contents can hold references."""
    return D.items(spark, sf_dir).where(S.can_refer(F.col("media_type"))).select("item_id", "media_type")


@query("""SELECT page_id, page_id % 3 = 1 AS scripted, CASE page_id % 3 WHEN 0 THEN 'style:u' || page_id || '.png' WHEN 1 THEN 'script:/d' || page_id ELSE '' END AS refs FROM pages""")
def resource_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of derived style sheets (some of them UTF-16), scripts and other resources by their types."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    style, script = F.concat(F.lit("p{background:url(u"), i, F.lit(".png)}")), F.concat(F.lit("fetch('/d"), i, F.lit("')"))
    content = F.when(k == 0, F.when(F.col("page_id") % 2 == 0, F.encode(style, "UTF-16")).otherwise(F.encode(style, "UTF-8"))).otherwise(F.encode(script, "UTF-8"))
    media = F.when(k == 0, "text/css").when(k == 1, "text/javascript").otherwise("application/json")
    found = D.load(spark, sf_dir, "pages").select("page_id", S.resource_references(content, media).alias("r"))
    return found.select("page_id", "r.scripted", F.array_join(F.transform("r.refs", lambda x: F.concat_ws(":", x["kind"], x["ref"])), " ").alias("refs"))


@query("""SELECT s_suppkey AS pkg, unnest(['a', 'b']) AS id, unnest(['t%20' || s_suppkey || '.xhtml', 'n' || s_nationkey || '.svg']) AS href, unnest(['application/xhtml+xml', 'image/svg+xml']) AS media_type,
  unnest(['nav,scripted', '']) AS properties, unnest(['b', NULL]) AS fallback FROM supplier""")
def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of derived package files."""
    text = F.concat(
        F.lit(f'<package xmlns="{S.OPF}"><metadata><item id="no"/></metadata><manifest><item id="a" href="t%20'), F.col("s_suppkey"),
        F.lit('.xhtml" media-type="application/xhtml+xml" properties=" nav  scripted nav" fallback="b"/><item id="b" href="n'), F.col("s_nationkey"),
        F.lit('.svg" media-type="image/svg+xml" fallback=""/><item xmlns="urn:x" id="c"/></manifest></package>'),
    )
    rows = D.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pkg"), scan.xml_flatten(F.encode(text, "UTF-8"))["rows"].alias("rows"))
    return rows.select("pkg", F.inline(S.manifest_items(F.col("rows")))).withColumn("properties", F.array_join("properties", ","))


@query(f"""SELECT s_suppkey AS id, unnest(range(6)) AS node, unnest(['https://{HOST}/a/', 'https://{HOST}/a/b' || s_suppkey || '/', 'https://{HOST}/a/b' || s_suppkey || '/', 'https://{HOST}/a/b' || s_suppkey || '/c/', 'https://{HOST}/a/b' || s_suppkey || '/c/', 'https://{HOST}/a/']) AS base,
  unnest([false, false, false, true, true, false]) AS in_frame FROM supplier""")
def section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base URLs and frames that elements of derived documents inherit."""
    text = F.concat(F.lit(f'<html xmlns="{S.XHTML}"><body xml:base="b'), F.col("s_suppkey"), F.lit('/"><iframe><p xml:base="c/"><i/></p></iframe></body><p/></html>'))
    found = D.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.inline(S.sections(F.encode(text, "UTF-8"), F.lit(f"https://{HOST}/a/"))["rows"]))
    return found.withColumn("node", F.col("node").cast("long"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_type || p_brand || ' ' || p_size AS text FROM part")
def body_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the bodies of derived documents."""
    parts = [F.lit(f'<html xmlns="{S.XHTML}"><head><title>no</title></head><body><h1>'), X.escape(F.col("p_name")), F.lit("</h1>"), X.escape(F.col("p_type")), F.lit("<b>")]
    parts += [X.escape(F.col("p_brand")), F.lit("</b><br/>  <div><p>"), F.col("p_size").cast("string"), F.lit("</p></div></body></html>")]
    return D.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.body_text(F.encode(F.concat(*parts), "UTF-8"))["text"].alias("text"))


@query(f"""WITH {D.PAGE_BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS k FROM page_blocks)
SELECT doc_id, page, pos, 'assets/page-' || page || '-image-' || k || '.jpeg' || CASE WHEN pos % 2 = 1 THEN '.png' ELSE '' END AS name, sha256(block) AS content_sha FROM n""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and digests of images, blocks of pages taken for their bytes."""
    rows = D.page_blocks(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1)
    return rows.select("doc_id", "page", "pos", S.extracted_name(F.col("page"), F.col("k"), F.lit("jpeg"), F.col("pos") % 2 == 1).alias("name"), F.sha2("block", 256).alias("content_sha"))


@query(f"""WITH {D.SPANS} SELECT doc_id, line, CAST(min(40 + 10 * (pos % 7)) AS DOUBLE) AS left_x, CAST(max(40 + 10 * (pos % 7) + 5 * length(text)) AS DOUBLE) AS right_x FROM spans GROUP BY doc_id, line""")
def line_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right ends of lines from the boxes of their spans."""
    left = (40 + 10 * (F.col("pos") % 7)).cast("double")
    return L.line_extents(D.spans(spark, sf_dir).select("doc_id", "line", left.alias("x0"), (left + 5 * F.length("text")).alias("x1")))


@query(f"""WITH {D.PAGE_BLOCKS} SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY length(block) % 3, length(block) % 2, pos) AS seq FROM page_blocks""")
def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pages from top to bottom and left to right, equal places in the given order."""
    size = F.length("block")
    return L.ordered_events(D.page_blocks(spark, sf_dir).withColumns({"top": size % 3, "left": size % 2})).select("doc_id", "page", "pos", F.col("seq").cast("long").alias("seq"))


_JUDGED = f"WITH {D.PATCHES}, v AS (SELECT doc_id, doc_id // 100 AS batch, {_SAID} AS said FROM patches)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = R.verdict(F.col("text"), F.col("original"), F.col("replacement"), F.col("confidence"), 0.3)
    return D.patches(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 100).cast("long").alias("batch"), said.alias("verdict"))


@query(f"""{_JUDGED} SELECT batch, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE said = 'applied'), '') AS applied,
  coalesce(string_agg(doc_id || ':' || said, ',' ORDER BY doc_id) FILTER (WHERE said <> 'applied'), '') AS rejected FROM v GROUP BY batch""")
def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied and rejected corrections of batches."""
    out = R.records(_judged(spark, sf_dir), "batch", "doc_id")
    rejected = F.transform("rejected", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["verdict"]))
    return out.select("batch", F.array_join(F.transform("applied", lambda x: x["doc_id"].cast("string")), ",").alias("applied"), F.array_join(rejected, ",").alias("rejected"))


@query(f"{_JUDGED} SELECT batch, doc_id FROM v QUALIFY row_number() OVER (PARTITION BY batch ORDER BY doc_id) <= 80")
def capped_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corrections of batches, as many as a request may bring."""
    return R.capped(_judged(spark, sf_dir), "batch", "doc_id").select("batch", "doc_id")


@query(f"""WITH {D.PAGE_BLOCKS} SELECT doc_id, sha256(string_agg(block, chr(10) ORDER BY page % 2, page, pos)) AS text_sha FROM page_blocks GROUP BY doc_id""")
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two lists of pages, one after the other."""
    rows = D.page_blocks(spark, sf_dir)
    joined = R.union_in_order([rows.where("page % 2 = 0"), rows.where("page % 2 = 1")])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "page", "pos", "block"))), lambda x: x["block"]), "\n")
    return joined.groupBy("doc_id").agg(F.sha2(texts, 256).alias("text_sha"))


_CHAPTERS = TEXT_ORACLE["html_chapters"][: TEXT_ORACLE["html_chapters"].rindex("SELECT page_id, CAST(chapter_index")]


@query(f"""{_CHAPTERS} SELECT c.page_id, count(*) AS chapters, any_value(n) AS assets FROM c JOIN (SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?i)src="([^"]*)"', 1))) AS BIGINT) AS n FROM pages) USING (page_id) GROUP BY c.page_id""")
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and assets of pages."""
    title = F.concat(F.lit("page "), F.col("page_id"))
    chapters = F.size(chapters_of(X.sanitize(F.col("html"))["clean"], title, closed_only=True)).cast("long")
    return D.load(spark, sf_dir, "pages").select("page_id", chapters.alias("chapters"), F.size(F.array_distinct(S.image_sources(F.col("html")))).cast("long").alias("assets"))


# SQL of the books and reports of the scan queries, which need the chapters' SQL.
_UNSAFE = f"""regexp_matches(html, '{X.FORBIDDEN}') OR regexp_matches(html, '{X.REMOTE_ASSET.replace("'", "''")}')"""
_PAGE = f"""'<!doctype html><html lang="vi"><head><meta charset="utf-8"><title>' || {s_escape('title')} || '</title></head><body><h1>' || {s_escape('title')} || '</h1>' || html || '</body></html>'"""
_SANITIZED = TEXT_ORACLE["html_sanitize"][: TEXT_ORACLE["html_sanitize"].rindex("SELECT page_id, sha256(")]
_LINES = [f"'<tr><td>HTML_SANITIZED</td><td>{m}</td></tr>'" for m in X.MESSAGES]
TEXT_ORACLE["span_decode"] = f"""WITH {D.SPANS}, t AS (SELECT *, translate(text, '{X.LEGACY_SOURCES}', '{X.LEGACY_TARGETS}') AS plain FROM spans)
SELECT doc_id, line, pos, nfc_normalize(CASE WHEN NOT starts_with(font, '.Vn') THEN text WHEN regexp_matches(font, 'H(?:,|$)') THEN upper(plain) ELSE plain END) AS decoded FROM t"""
SCAN_ORACLE |= {
    "render_books": f"""{_CHAPTERS} SELECT page_id, sha256(m) AS markup_sha, CAST(length(m) AS INTEGER) AS chars
FROM (SELECT page_id, string_agg('<section><h1>' || {s_escape('title')} || '</h1>' || html || '</section>', chr(10) ORDER BY chapter_index) AS m FROM c GROUP BY page_id)""",
    "reader_files": f"""{_CHAPTERS} SELECT page_id, format('{{:03d}}', chapter_index + 1) || '-' || {s_safe('title')} || '.xhtml' AS filename,
  CASE WHEN NOT ({_UNSAFE}) THEN sha256({_PAGE}) END AS content_sha FROM (SELECT page_id, CAST(chapter_index AS BIGINT) AS chapter_index, title, html FROM c)""",
    "report_html": f"""{_SANITIZED}, m AS (SELECT page_id, length({s_sub('h4', _IMAGE)}) AS n, list_sort(list_filter([
    CASE WHEN h0 <> h2 THEN {_LINES[0]} END, CASE WHEN h2 <> h4 THEN {_LINES[1]} END, CASE WHEN h4 <> {s_sub('h4', _IMAGE)} THEN {_LINES[2]} END], lambda x: x IS NOT NULL)) AS w FROM d)
SELECT page_id, '<h1>Report</h1><table>' || CASE WHEN len(w) = 0 THEN '<tr><td>none</td></tr>' ELSE array_to_string(w, '') END || '</table><table><tr><td>chars</td><td>' || n || '</td></tr></table>' AS report FROM m""",
    "book_json": f"""{_CHAPTERS} SELECT page_id, CAST(to_json({{'schema_version': '2', 'chapters': list({{'title': title, 'html': html}} ORDER BY chapter_index)}}) AS VARCHAR) AS json FROM c GROUP BY page_id""",
}
