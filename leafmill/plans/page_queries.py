"""Queries over pages, lines and spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as L
from ..operators import pages as P
from ..sources import derived as D
from .text_queries import s_key, s_strip, s_sub

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


_TOP = f"""{D.PAGE_BLOCKS}, keyed AS (SELECT *, {s_key('block')} AS header FROM page_blocks),
runs AS (SELECT doc_id, header, count(*) AS n, min(page) AS first_page FROM keyed WHERE pos < 2 AND header <> '' AND length(header) <= 120 AND len(string_split(header, ' ')) <= 12
  GROUP BY doc_id, header HAVING count(*) >= 3)"""


@query(f"WITH {_TOP} SELECT doc_id, header, n, first_page FROM runs")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that repeat on the pages of a document."""
    return P.running_headers(D.page_blocks(spark, sf_dir))


@query(f"""WITH {_TOP}, r AS (SELECT keyed.*, n, first_page, count(*) FILTER (WHERE pos < 2 AND regexp_matches(keyed.header, '{P.ROMAN}')) OVER (PARTITION BY keyed.doc_id) AS romans
  FROM keyed LEFT JOIN runs ON runs.doc_id = keyed.doc_id AND runs.header = keyed.header),
j AS (SELECT *, CASE WHEN pos < 2 AND romans >= 3 AND regexp_matches(header, '{P.ROMAN}') THEN 'roman'
  WHEN pos < 2 AND n IS NOT NULL AND NOT (page = first_page AND starts_with(ltrim(block), '#')) THEN 'header' END AS reason FROM r)
SELECT doc_id, page, sha256(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE reason IS NULL), '')) AS cleaned_sha,
  count(*) FILTER (WHERE reason = 'header') AS removed_headers, count(*) FILTER (WHERE reason = 'roman') AS removed_roman FROM j GROUP BY doc_id, page""")
def remove_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without running headers and Roman page numbers."""
    done = P.remove_artifacts(D.page_blocks(spark, sf_dir))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("pos", "block")))), lambda x: x["block"]), "\n\n")
    return done.groupBy("doc_id", "page").agg(F.sha2(kept, 256).alias("cleaned_sha"), F.count_if(F.col("reason") == "header").alias("removed_headers"), F.count_if(F.col("reason") == "roman").alias("removed_roman"))


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END AS BIGINT) AS converted,
  CASE k WHEN 0 THEN 'a[^1] b[^2]|[^1]: one|[^2]: two' WHEN 1 THEN 'a[^1] b<sup>2</sup>|[^1]: one' WHEN 2 THEN 'a<sup>7</sup>|1. one' ELSE 'a|1. one' END AS page FROM p""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnote marks linked to the blocks that explain them, in four shapes of a page."""
    shapes = [("a<sup>1</sup> b<sup>2</sup>", "1. one", "2.  two"), ("a<sup>1</sup> b<sup>2</sup>", "1. one"), ("a<sup>7</sup>", "1. one"), ("a", "1. one")]
    page = F.element_at(F.array(*[F.array(*[F.lit(b) for b in s]) for s in shapes]), (F.col("doc_id") % 4 + 1).cast("int"))
    done = D.load(spark, sf_dir, "documents").select("doc_id", P.footnotes(page).alias("f"))
    return done.select("doc_id", F.col("f.n").alias("converted"), F.array_join("f.blocks", "|").alias("page"))


_MARKED = "CASE WHEN pos % 4 IN (1, 2) THEN '* *' WHEN pos % 7 = 3 THEN '***' ELSE block END"


@query(f"""WITH {D.BLOCKS}, o AS (SELECT doc_id, pos, {_MARKED} AS b FROM blocks), m AS (SELECT *, regexp_matches(b, '{P.ORNAMENT}') AS orn FROM o),
e AS (SELECT *, orn AND NOT coalesce(lead(orn) OVER (PARTITION BY doc_id ORDER BY pos), false) AS last FROM m)
SELECT doc_id, CAST(count(*) FILTER (WHERE last) AS BIGINT) AS n_collapsed, CAST(count(*) FILTER (WHERE last OR NOT orn) AS BIGINT) AS n_blocks FROM e GROUP BY doc_id""")
def ornaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ornaments as single dividers, some lines being made ornaments."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 4).isin(1, 2), "* *").when(i % 7 == 3, "***").otherwise(x))
    done = D.load(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.collapse_ornaments(marked).alias("o"))
    return done.select("doc_id", F.col("o.collapsed").alias("n_collapsed"), F.size("o.blocks").cast("long").alias("n_blocks"))


def s_visible(x: str) -> str:
    return s_strip(s_sub(s_sub(x, "<[^>]+>"), r"[*_`#\[\]()]"))


@query(f"""WITH {D.PAGE_BLOCKS}, e AS (SELECT doc_id, page, arg_max(block, pos) AS last, arg_min(block, pos) AS first FROM page_blocks WHERE pos >= 2 GROUP BY doc_id, page),
n AS (SELECT doc_id, page, {s_visible('last')} AS a, {s_visible('lead(first) OVER (PARTITION BY doc_id ORDER BY page)')} AS b FROM e)
SELECT doc_id, page, coalesce(length(a) >= 120 AND length(b) >= 40 AND regexp_matches(regexp_extract(b, '\\p{{L}}'), '^\\p{{Ll}}') AND NOT regexp_matches(a, '{P.SENTENCE_END.replace("'", "''")}'), false) AS joined FROM n""")
def page_flow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose last paragraph goes on on the next page."""
    return P.join_pages(D.page_blocks(spark, sf_dir).where("pos >= 2"))


_STEP = f"""{D.GEO_LINES}, st AS (SELECT *, lead(baseline) OVER w - baseline AS step FROM geo_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sp AS (SELECT doc_id, coalesce(median(step) FILTER (WHERE step > 0.7 * size AND step < 2.2 * size), 0.0) AS spacing FROM st GROUP BY doc_id)"""


@query(f"WITH {_STEP} SELECT doc_id, CAST(spacing AS DOUBLE) AS spacing FROM sp")
def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line spacing of documents."""
    return L.line_spacing(D.geo_lines(spark, sf_dir))


_REFLOW = rf"""{_STEP}, mg AS (SELECT a.doc_id, a.left_x, a.right_x, max(b.right_x) AS margin FROM (SELECT DISTINCT doc_id, left_x, right_x FROM geo_lines) a
  JOIN (SELECT DISTINCT doc_id, left_x, right_x FROM geo_lines) b ON a.doc_id = b.doc_id AND b.left_x < a.right_x AND b.right_x > a.left_x GROUP BY ALL),
ln AS (SELECT g.*, margin, spacing FROM geo_lines g JOIN mg USING (doc_id, left_x, right_x) JOIN sp USING (doc_id)),
pv AS (SELECT *, lag(baseline) OVER w AS pb, lag(bold) OVER w AS pbold, lag(left_x) OVER w AS pl, lag(right_x) OVER w AS pr, lag(margin) OVER w AS pm FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
jn AS (SELECT *, CASE WHEN pb IS NOT NULL AND spacing > 0 AND pbold = bold AND baseline - pb > 7 AND baseline - pb <= spacing * 1.25 AND left_x - pl >= -25 AND left_x - pl <= 6 AND pr >= pm - 20
  AND NOT regexp_matches(text, '{L.LIST_START}') THEN 0 ELSE 1 END AS starts FROM pv),
rf AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS para FROM jn)"""


@query(f"WITH {_REFLOW} SELECT doc_id, CAST(para AS BIGINT) AS para, sha256(string_agg(text, ' ' ORDER BY pos)) AS text_sha FROM rf GROUP BY doc_id, para")
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs from lines."""
    return L.paragraphs(D.geo_lines(spark, sf_dir)).select("doc_id", "para", F.sha2("text", 256).alias("text_sha"))


_TWO = "SELECT doc_id, pos, baseline - 15 * (pos % 2) * (doc_id % 2) AS baseline, CASE WHEN pos % 2 = 1 AND doc_id % 2 = 1 THEN 200.0 ELSE 40.0 END AS left_x, CASE WHEN pos % 2 = 1 AND doc_id % 2 = 1 THEN 350.0 ELSE 180.0 END AS right_x, size FROM geo_lines"


@query(f"""WITH {D.GEO_LINES}, t AS ({_TWO}), s AS (SELECT *, lead(baseline) OVER w AS nb, lead(left_x) OVER w AS nl, lead(size) OVER w AS ns, min(baseline) OVER (PARTITION BY doc_id) AS fb, max(baseline) OVER (PARTITION BY doc_id) AS lb
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY baseline, left_x))
SELECT doc_id, bool_or(coalesce(NOT (abs(baseline - fb) < size * 0.25 OR abs(nb - lb) < ns * 0.25) AND abs(baseline - nb) < 2.5 AND nl - right_x > 10, false)) AS ambiguous FROM s GROUP BY doc_id""")
def column_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with parallel columns, every second one being set in two."""
    lines = D.geo_lines(spark, sf_dir)
    second = (F.col("pos") % 2 == 1) & (F.col("doc_id") % 2 == 1)
    two = lines.withColumn("baseline", F.col("baseline") - F.when(second, 15.0).otherwise(0.0)).withColumn("left_x", F.when(second, 200.0).otherwise(40.0)).withColumn("right_x", F.when(second, 350.0).otherwise(180.0))
    return L.column_ambiguity(two)


_WAVY = "baseline - 15 * (pos % 3) + CASE pos % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 ELSE 0.0 END"


@query(f"""WITH RECURSIVE {D.GEO_LINES}, v AS (SELECT doc_id, {_WAVY} AS y FROM geo_lines), o AS (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY y) AS i FROM v),
walk AS (SELECT doc_id, i, y, y AS anchor, CAST(0 AS BIGINT) AS band FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, o.y, CASE WHEN o.y - anchor <= 2.5 THEN anchor ELSE o.y END, CASE WHEN o.y - anchor <= 2.5 THEN band ELSE band + 1 END FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.i = walk.i + 1)
SELECT doc_id, band, count(*) AS n FROM walk GROUP BY doc_id, band""")
def baseline_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lines on one baseline, the lines being made to drift."""
    k = F.col("pos") % 3
    drift = F.col("baseline") - 15 * k + F.when(k == 1, 2.0).when(k == 2, 4.0).otherwise(0.0)
    return L.bands(D.geo_lines(spark, sf_dir).select("doc_id", drift.alias("baseline")), 2.5)


@query("""SELECT item_id AS doc_id, CASE WHEN k IN (0, 1) THEN CAST(2 AS BIGINT) END AS groups, CASE k WHEN 0 THEN CAST(7 AS BIGINT) WHEN 1 THEN CAST(6 AS BIGINT) END AS members
FROM (SELECT s_suppkey AS item_id, s_suppkey % 4 AS k FROM supplier)""")
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headed lists of names and roles: a good one with a lone name, a good one, one with a lower-case name, one too short."""
    cell = lambda x0, x1, text: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(text).alias("text"))

    def page(names: list[str], lone: bool) -> F.Column:
        rows, y = [], 100.0
        for head in ("GROUP ONE", "GROUP TWO"):
            rows.append(F.struct(F.lit(y).alias("baseline"), F.array(cell(150.0, 210.0, head)).alias("cells")))
            for name in names:
                y += 15
                rows.append(F.struct(F.lit(y).alias("baseline"), F.array(cell(40.0, 120.0, name), cell(240.0, 320.0, "Role of it")).alias("cells")))
            y += 15
        if lone:
            rows.append(F.struct(F.lit(y).alias("baseline"), F.array(cell(40.0, 120.0, "LAST NAME")).alias("cells")))
        return F.array(*rows)

    names = ["ANN A", "BOB B", "CAT C"]
    shapes = F.array(page(names, True), page(names, False), page(["ANN A", "Bob B", "CAT C"], False), page(names[:2], False))
    rows = D.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.element_at(shapes, (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("band", "r"))
    return L.rosters(rows.select("doc_id", "band", "r.baseline", "r.cells"), 10.0)


def _rect_overlap(above: DataFrame, below: DataFrame) -> DataFrame:
    x = (F.col("pos") * 13 % 400).cast("double")
    rects = above.select("doc_id", F.col("pos").alias("rect"), x.alias("x0"), (F.col("baseline") - 3).alias("y0"), (x + 5).alias("x1"), (F.col("baseline") + 30 * (F.col("pos") % 3)).alias("y1"))
    boxes = below.select("doc_id", F.col("left_x").alias("x0"), (F.col("baseline") - 8).alias("y0"), F.col("right_x").alias("x1"), F.col("baseline").alias("y1"))
    return L.rect_overlaps(rects, boxes, 50.0)


_ALL_RECTS = "SELECT doc_id, pos AS rect, CAST(pos * 13 % 400 AS DOUBLE) AS x0, baseline - 3 AS y0, CAST(pos * 13 % 400 + 5 AS DOUBLE) AS x1, baseline + 30 * (pos % 3) AS y1 FROM geo_lines"
_ALL_BOXES = "SELECT doc_id, left_x AS x0, baseline - 8 AS y0, right_x AS x1, baseline AS y1 FROM geo_lines"


@query(f"""WITH {D.GEO_LINES}, r AS ({_ALL_RECTS}), b AS ({_ALL_BOXES})
SELECT doc_id, rect, EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND r.x0 < b.x1 AND r.x1 > b.x0 AND r.y0 < b.y1 AND r.y1 > b.y0) AS overlaps FROM r""")
def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of all lines that meet text boxes of all lines."""
    lines = D.geo_lines(spark, sf_dir)
    return _rect_overlap(lines, lines)


@query(f"WITH {D.SPANS} SELECT doc_id, line, arg_max(pos, (length({s_strip('text')}), -pos)) AS pos, arg_max(text, (length({s_strip('text')}), -pos)) AS text FROM spans GROUP BY doc_id, line")
def longest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main spans of all lines."""
    return L.main_spans(D.spans(spark, sf_dir))


def _styled(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.bool_or(F.col("flags").bitwiseAND(F.lit(19)) != 0).alias("styled"))


@query(f"WITH {D.SPANS} SELECT doc_id, bool_or((flags & 19) <> 0) AS styled FROM spans GROUP BY doc_id")
def styled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with styled spans anywhere."""
    return _styled(D.spans(spark, sf_dir))


@query("SELECT conv_id, turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role = 'user') AS previous FROM conversations a")
def as_of_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn before each turn."""
    return L.last_before(D.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user").drop("role")


@query(f"""WITH {_REFLOW}, p AS (SELECT doc_id, para, string_agg(text, ' ' ORDER BY pos) AS t FROM rf GROUP BY doc_id, para), a AS (SELECT doc_id, string_agg(t, ' ' ORDER BY para) AS t FROM p GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS t FROM geo_lines GROUP BY doc_id) SELECT doc_id, trim(regexp_replace(a.t, '\\s+', ' ', 'g')) = trim(regexp_replace(b.t, '\\s+', ' ', 'g')) AS text_equal FROM a JOIN b USING (doc_id)""")
def conservation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether reflowed paragraphs hold exactly the text of the lines."""
    lines = D.geo_lines(spark, sf_dir)
    whole = lambda f, order: f.groupBy("doc_id").agg(X.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")).alias(f"t_{order}"))
    return whole(L.paragraphs(lines), "para").join(whole(lines, "pos"), "doc_id").select("doc_id", (F.col("t_para") == F.col("t_pos")).alias("text_equal"))
