"""Document, page, line and item tables derived from the stored ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, pos, block."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))


BLOCKS = """blocks AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS block
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"""

_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents: doc_id, page, pos, block."""
    turns = load(spark, sf_dir, "conversations")
    even = F.col("turn") % 2 == 0
    head = F.when(even, F.concat(F.lit("## Running "), F.col("conv_id"))).otherwise(F.concat(F.lit("*running "), F.col("conv_id"), F.lit("*")))
    number = F.element_at(F.array(*[F.lit(r) for r in _ROMAN]), (F.col("turn") % 10 + 1).cast("int"))
    flat = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.+$", "")
    third = F.when(even, F.lit("A complete sentence.")).otherwise(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))))
    fourth = F.when(even, flat).otherwise(F.lit("Another complete sentence."))
    out = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.posexplode(F.array(head, number, third, fourth)).alias("pos", "block"))
    return out.withColumn("pos", F.col("pos").cast("long"))


PAGE_BLOCKS = f"""page_blocks AS (SELECT conv_id AS doc_id, turn + 1 AS page, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS block
  FROM (SELECT conv_id, turn, [
    CASE WHEN turn % 2 = 0 THEN '## Running ' || conv_id ELSE '*running ' || conv_id || '*' END,
    {list(_ROMAN)!r}[turn % 10 + 1],
    CASE WHEN turn % 2 = 0 THEN 'A complete sentence.' ELSE lower(replace(text, chr(10), ' ')) END,
    CASE WHEN turn % 2 = 0 THEN regexp_replace(replace(text, chr(10), ' '), '\\.+$', '') ELSE 'Another complete sentence.' END] AS a FROM conversations))"""


def geo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a geometry: doc_id, pos, text, baseline, left_x, right_x, size, bold."""
    pos = F.col("pos")
    return blocks(spark, sf_dir).select(
        "doc_id",
        "pos",
        F.col("block").alias("text"),
        (50.0 + 15 * pos + 20 * F.floor(pos / 9)).cast("double").alias("baseline"),
        F.when(pos % 5 == 0, 60.0).otherwise(40.0).alias("left_x"),
        F.when(pos % 5 == 4, 180.0).otherwise(350.0).alias("right_x"),
        F.lit(10.0).alias("size"),
        (pos % 17 == 16).alias("bold"),
    )


GEO_LINES = f"""{BLOCKS}, geo_lines AS (SELECT doc_id, pos, block AS text, CAST(50 + 15 * pos + 20 * (pos // 9) AS DOUBLE) AS baseline,
  CASE WHEN pos % 5 = 0 THEN 60.0 ELSE 40.0 END AS left_x, CASE WHEN pos % 5 = 4 THEN 180.0 ELSE 350.0 END AS right_x,
  10.0 AS size, pos % 17 = 16 AS bold FROM blocks)"""

# Media types of the derived items.
_MEDIA = ("application/xhtml+xml", "image/svg+xml", "video/mp4", "application/x-custom", "text/css")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as manifest items: item_id, path, media_type, fallback."""
    i = F.col("s_suppkey")
    fallback = F.when(i % 7 == 0, None).when(i % 41 == 3, i - 2).when(i % 37 == 5, F.lit(1000000)).otherwise(i + 1)
    media = F.element_at(F.array(*[F.lit(m) for m in _MEDIA]), (i % 5 + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select(i.alias("item_id"), F.concat(F.lit("text/"), i, F.lit(".xhtml")).alias("path"), media.alias("media_type"), fallback.cast("long").alias("fallback"))


ITEMS = f"""items AS (SELECT s_suppkey AS item_id, 'text/' || s_suppkey || '.xhtml' AS path, {list(_MEDIA)!r}[s_suppkey % 5 + 1] AS media_type,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 41 = 3 THEN s_suppkey - 2 WHEN s_suppkey % 37 = 5 THEN 1000000 ELSE s_suppkey + 1 END AS fallback FROM supplier)"""

# Fonts of the derived spans.
_FONTS = (".VnTime", ".VnTimeH", "Times", "Times-Bold", ".VnArial")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all lines as styled spans: doc_id, line, pos, text, font, flags."""
    words = blocks(spark, sf_dir).select("doc_id", F.col("pos").alias("line"), F.posexplode(F.split("block", " ")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    font = F.element_at(F.array(*[F.lit(f) for f in _FONTS]), (F.col("pos") % 5 + 1).cast("int"))
    return words.withColumn("font", font).withColumn("flags", (F.col("pos") * 7 + F.col("doc_id")) % 32)


SPANS = f"""{BLOCKS}, spans AS (SELECT doc_id, line, pos, text, {list(_FONTS)!r}[pos % 5 + 1] AS font, (pos * 7 + doc_id) % 32 AS flags
  FROM (SELECT doc_id, pos AS line, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS text FROM (SELECT doc_id, pos, string_split(block, ' ') AS w FROM blocks)))"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with active markup, an unsafe link or a remote image added: page_id, url, html."""
    k = F.col("page_id") % 4
    more = F.when(k == 0, '<p onclick="x()">a</p><iframe src="b">').when(k == 1, '<a href="javascript:go()">b</a>').when(k == 2, '<img alt="" src="https://cdn.example.com/i.png">').otherwise("")
    return load(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", more).alias("html"))


MARKED_PAGES = """marked AS (SELECT page_id, url, html || CASE page_id % 4 WHEN 0 THEN '<p onclick="x()">a</p><iframe src="b">'
  WHEN 1 THEN '<a href="javascript:go()">b</a>' WHEN 2 THEN '<img alt="" src="https://cdn.example.com/i.png">' ELSE '' END AS html FROM pages)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposed correction per document: doc_id, seq, text, original, replacement, confidence."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    first = F.element_at(F.split("text", "\n"), 1)
    k = F.col("doc_id") % 6
    new = F.when(k == 0, F.concat(first, F.lit("!"))).when(k == 1, F.concat(F.lit("!["), first)).when(k == 2, F.concat(first, F.lit(" https://a.example/"))).when(k == 3, F.repeat(first, 3)).when(k == 4, F.upper(F.substring(first, 1, 1))).otherwise(first)
    return docs.select("doc_id", F.lit(0).cast("long").alias("seq"), "text", first.alias("original"), new.alias("replacement"), ((F.col("doc_id") % 10) / 10.0).cast("double").alias("confidence"))


PATCHES = """patches AS (SELECT doc_id, CAST(0 AS BIGINT) AS seq, text, o AS original, CASE doc_id % 6 WHEN 0 THEN o || '!' WHEN 1 THEN '![' || o
  WHEN 2 THEN o || ' https://a.example/' WHEN 3 THEN repeat(o, 3) WHEN 4 THEN replace(upper(replace(substr(o, 1, 1), 'ß', 'SS')), 'ẞ', 'SS') ELSE o END AS replacement, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS confidence
  FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS o FROM documents WHERE text IS NOT NULL))"""
