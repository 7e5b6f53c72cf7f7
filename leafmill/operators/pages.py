"""Operators on the pages of a document: artefacts, footnotes, ornaments, text flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NUMBER = r"^\s*[0-9]{1,4}\s*$"
MARKER = r"(?i)^\s*[0-9]+\s+of\s+[0-9]+\s*$"
ROMAN = r"(?i)^[ivxlcdm]{1,8}$"
ORNAMENT = r"^(?:\*\s*){1,3}$"
DIVIDER = '<div class="ornament">* * *</div>'
SENTENCE_END = r"[.?!…][\"”’')\]}]*$"


SECTION = r"^\s*(?:[-*]\s+)?\*\*<u>([0-9]+\.\s+[^<]+)</u>\*\*\s*(.*)$"
TITLE = r"^\s*\*\*<u>([^<]+)</u>\*\*\s*$"
UNDERLINED = r"^(#{1,6})\s*<u>(.*?)</u>\s*$"


def clean_markdown(value: Column) -> Column:
    """Struct of the cleaned ``text`` of extracted Markdown and the counts of what went: ``numbers`` and ``markers``.

    Page markers go, and bare numbers if there are ten.  Underlined bold numbered lines become headings, what follows
    on the line a paragraph; an underlined bold line becomes the title if nothing visible stands before it;
    underlining of headings goes, as do blanks at line ends and all but two of many empty lines.
    """
    lines = F.split(F.replace(value, F.lit("\r\n"), F.lit("\n")), "\n")
    seen = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(NUMBER).alias("number"), x.rlike(MARKER).alias("marker")))
    counted = lambda all_: F.struct(all_.alias("lines"), (F.size(F.filter(all_, lambda x: x["number"])) >= 10).alias("many"))
    return X.let(X.let(seen, counted), lambda c: _cleaned(c["lines"], c["many"]))


def _cleaned(lines: Column, many: Column) -> Column:
    kept = F.transform(F.filter(lines, lambda x: ~x["marker"] & ~(many & x["number"])), lambda x: x["line"])
    placed = lambda k: F.struct(k.alias("kept"), F.array_position(F.transform(k, lambda x: X.strip(x) != ""), True).alias("first"))
    heading = lambda x, p: F.concat(F.lit("# "), X.strip(F.regexp_extract(x, p, 1)))

    def line(x: Column, i: Column, first: Column) -> Column:
        rest = X.strip(F.regexp_extract(x, SECTION, 2))
        section = F.when(rest == "", F.array(heading(x, SECTION), F.lit(""))).otherwise(F.array(heading(x, SECTION), F.lit(""), rest, F.lit("")))
        plain = F.rtrim(F.regexp_replace(x, UNDERLINED, "$1 $2"))
        return F.when(x.rlike(SECTION), section).when(x.rlike(TITLE) & (i + 1 == first), F.array(heading(x, TITLE), F.lit(""))).otherwise(F.array(plain))

    text = X.let(X.let(kept, placed), lambda c: F.array_join(F.flatten(F.transform(c["kept"], lambda x, i: line(x, i, c["first"]))), "\n"))
    return F.struct(
        F.concat(X.strip(F.regexp_replace(text, "\n{4,}", "\n\n\n")), F.lit("\n")).alias("text"),
        F.when(many, F.size(F.filter(lines, lambda x: x["number"] & ~x["marker"]))).otherwise(0).cast("long").alias("numbers"),
        F.size(F.filter(lines, lambda x: x["marker"])).cast("long").alias("markers"),
    )


def running_headers(rows: DataFrame) -> DataFrame:
    """doc_id, header, n, first_page of keys among the first two blocks of at least three pages' blocks."""
    top = rows.where("pos < 2").withColumn("header", X.header_key(F.col("block")))
    short = top.where((F.col("header") != "") & (F.length("header") <= 120) & (F.size(F.split("header", " ")) <= 12))
    return short.groupBy("doc_id", "header").agg(F.count("*").alias("n"), F.min("page").alias("first_page")).where("n >= 3")


def remove_artifacts(rows: DataFrame) -> DataFrame:
    """Blocks with ``reason``: ``roman`` or ``header`` for those to be removed, else null.

    Roman page numbers go where a document has three among the first two blocks of its pages; running headers go
    except the first, if it is a heading.
    """
    keyed = rows.withColumn("header", X.header_key(F.col("block")))
    top = F.col("pos") < 2
    roman = top & F.col("header").rlike(ROMAN)
    keyed = keyed.withColumn("romans", F.count_if(roman).over(Window.partitionBy("doc_id")))
    found = keyed.join(running_headers(rows), ["doc_id", "header"], "left")
    keep = (F.col("page") == F.col("first_page")) & F.ltrim("block").startswith("#")
    reason = F.when(roman & (F.col("romans") >= 3), "roman").when(top & F.col("n").isNotNull() & ~keep, "header")
    return found.select(*rows.columns, reason.alias("reason"))


def footnotes(pages: Column) -> Column:
    """Blocks of a page with markers ``<sup>n</sup>`` and the first block ``n. text`` made footnotes, and how many."""
    marks = F.array_distinct(F.regexp_extract_all(F.array_join(pages, "\n"), F.lit(r"<sup>(\d{1,3})</sup>"), F.lit(1)))
    start = F.struct(pages.alias("blocks"), F.lit(0).cast("long").alias("n"))

    def one(done: Column, mark: Column) -> Column:
        blocks = done["blocks"]
        hits = F.transform(blocks, lambda b: F.startswith(b, F.concat(mark, F.lit(". "))) & (F.length(X.strip(F.substring(b, F.length(mark) + 2, F.length(b)))) > 0))
        at = F.array_position(hits, True)
        linked = F.transform(
            blocks,
            lambda b, i: F.when(
                i + 1 == at,
                F.concat(F.lit("[^"), mark, F.lit("]: "), X.strip(F.replace(F.substring(b, F.length(mark) + 2, F.length(b)), F.concat(F.lit("<sup>"), mark, F.lit("</sup>")), F.concat(F.lit("[^"), mark, F.lit("]"))))),
            ).otherwise(F.replace(b, F.concat(F.lit("<sup>"), mark, F.lit("</sup>")), F.concat(F.lit("[^"), mark, F.lit("]")))),
        )
        return F.when(at > 0, F.struct(linked.alias("blocks"), (done["n"] + 1).alias("n"))).otherwise(done)

    return F.aggregate(marks, start, one)


def collapse_ornaments(blocks: Column) -> Column:
    """Struct of ``blocks`` with every run of ornaments made one divider, and ``collapsed``."""
    is_ornament = lambda x: x.rlike(ORNAMENT)
    ends = lambda x, i: is_ornament(x) & ~F.coalesce(is_ornament(F.get(blocks, i + 1)), F.lit(False))
    marked = F.transform(blocks, lambda x, i: F.when(ends(x, i), F.lit(DIVIDER)).when(is_ornament(x), None).otherwise(x))
    kept = F.filter(marked, lambda x: x.isNotNull())
    runs = F.size(F.filter(F.transform(blocks, ends), lambda x: x))
    return F.struct(kept.alias("blocks"), runs.cast("long").alias("collapsed"))


def join_pages(rows: DataFrame) -> DataFrame:
    """doc_id, page, joined: whether the first running paragraph of the next page continues the last one of this page.

    Notes and ornaments do not count.  Joins run from page to page: a page whose only paragraph has just been taken
    over has none left to join with the page after it, and then the page after that starts anew.
    """
    flowing = rows.where(~(F.startswith("block", F.lit("[^")) | F.contains("block", F.lit('class="ornament"'))))
    ends = flowing.groupBy("doc_id", "page").agg(F.max_by("block", "pos").alias("last"), F.min_by("block", "pos").alias("first"), F.count("*").alias("blocks"))
    pages = rows.select("doc_id", "page").distinct().join(ends, ["doc_id", "page"], "left")
    by_page = Window.partitionBy("doc_id").orderBy("page")
    seen = pages.withColumn("next", F.lead("first").over(by_page)).withColumn("at", F.row_number().over(by_page))
    last, following = X.visible_text(F.col("last")), X.visible_text(F.col("next"))
    letter = F.regexp_extract(following, r"\p{L}", 0)
    fits = (
        (F.length(last) >= 120)
        & (F.length(following) >= 40)
        & (letter != "")
        & letter.rlike(r"^\p{Ll}")
        & ~last.rlike(SENTENCE_END)
        & ~F.contains("last", F.lit("<table"))
        & ~F.contains("next", F.lit("<table"))
    )
    seen = seen.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("single", F.coalesce(F.col("blocks") == 1, F.lit(False)))
    # A page loses its only paragraph if the page before joined with it; runs of such pages alternate.
    chained = seen.withColumn("linked", F.col("single") & F.coalesce(F.lag("fits").over(by_page), F.lit(False)))
    run = chained.withColumn("start", F.max(F.when(~F.col("linked"), F.col("at"))).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.col("fits") & ((F.col("at") - F.coalesce("start", F.lit(1))) % 2 == 0)
    return run.select("doc_id", "page", joined.alias("joined"))
