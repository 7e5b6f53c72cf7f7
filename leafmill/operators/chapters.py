"""Chapters of markup, built inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

HEADING = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>"


def chapters_of(markup: Column, title: Column, closed_only: bool = False) -> Column:
    """Array of struct(title, html) for sanitised markup.

    What stands before the first heading is a chapter if it shows text; a chapter that shows none is dropped; one
    whose title is that of the chapter before is appended to it; without chapters the whole body is one.
    ``closed_only``: character references in titles need their semicolon.
    """
    cut = lambda body: F.struct(body.alias("body"), F.regexp_extract_all(body, F.lit(HEADING), F.lit(1)).alias("heads"), F.split(body, HEADING, -1).alias("parts"))
    return X.let(X.let(X.body(markup), cut), lambda c: _chapters(c["body"], c["heads"], c["parts"], title, closed_only))


def _chapters(body: Column, heads: Column, parts: Column, title: Column, closed_only: bool) -> Column:
    named = lambda i: F.when(i == 0, title).otherwise(F.coalesce(F.nullif(X.plain_heading(F.get(heads, i - 1), closed_only), F.lit("")), title))
    found = F.transform(parts, lambda part, i: F.struct(named(i).alias("title"), X.strip(part).alias("html")))
    shown = F.filter(found, lambda c: X.plain_heading(c["html"], closed_only) != "")
    keyed = F.transform(shown, lambda c: F.struct(c["title"].alias("title"), c["html"].alias("html"), X.casefold(c["title"]).alias("key")))

    def grouped(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda c, i: F.when((i == 0) | (c["key"] != F.get(all_, i - 1)["key"]), i)), lambda i: i.isNotNull())
        return X.let(starts, lambda at: F.transform(at, lambda first, k: _joined(all_, first, F.coalesce(F.get(at, k + 1), F.size(all_)))))

    one = F.array(F.struct(title.alias("title"), body.alias("html")))
    return X.let(keyed, lambda all_: F.when((F.size(heads) > 0) & (F.size(all_) > 0), grouped(all_)).otherwise(one))


def _joined(all_: Column, first: Column, end: Column) -> Column:
    """The chapters from ``first`` up to ``end`` as one, under the first one's title."""
    html = F.array_join(F.transform(F.slice(all_, first + 1, end - first), lambda c: c["html"]), "\n")
    return F.struct(F.get(all_, first)["title"].alias("title"), html.alias("html"))


def html_chapters(pages: DataFrame, key: str, markup: str, title: Column, closed_only: bool = False) -> DataFrame:
    """``key, chapter_index, title, html`` of sanitised pages."""
    clean = pages.select(key, title.alias("_title"), X.sanitize(F.col(markup))["clean"].alias("_html"))
    return clean.select(key, F.posexplode(chapters_of(F.col("_html"), F.col("_title"), closed_only)).alias("chapter_index", "c")).select(
        key, F.col("chapter_index").cast("long").alias("chapter_index"), "c.title", "c.html"
    )
