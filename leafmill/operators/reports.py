"""Rendering of books, reader files, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _ordered(order: str, value: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]), separator)


def render(chapters: DataFrame, key: str) -> DataFrame:
    """key, markup: all chapters of a book (key, chapter_index, title, html) as one; null if none has markup."""
    section = F.concat(F.lit("<section><h1>"), X.escape(F.col("title")), F.lit("</h1>"), F.col("html"), F.lit("</section>"))
    return chapters.groupBy(key).agg(F.when(F.count(section) > 0, _ordered("chapter_index", section, "\n")).alias("markup"))


def reader_files(chapters: DataFrame, key: str, language: str = "vi") -> DataFrame:
    """key, filename, content: a page for each chapter; chapters with forbidden markup get a null content."""
    title = X.escape(F.col("title"))
    page = F.concat(
        F.lit(f'<!doctype html><html lang="{language}"><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), F.col("html"), F.lit("</body></html>")
    )
    unsafe = F.col("html").rlike(X.FORBIDDEN) | F.col("html").rlike(X.REMOTE_ASSET)
    return chapters.select(key, X.numbered_name(F.col("chapter_index") + 1, F.col("title")).alias("filename"), F.when(~unsafe, page).alias("content"))


def book_json(chapters: DataFrame, key: str) -> DataFrame:
    """key, json: the canonical dump of a book."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "title", "html"))), lambda c: F.struct(c["title"].alias("title"), c["html"].alias("html")))
    return chapters.groupBy(key).agg(parts.alias("chapters")).select(key, F.to_json(F.struct(F.lit("2").alias("schema_version"), "chapters")).alias("json"))


def report_html(warnings: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """key, report: warnings (key, code, message) and quality (key, metric, value) as tables, ``none`` where empty."""
    line = lambda *cols: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), X.escape(F.col(c).cast("string")), F.lit("</td>")) for c in cols], F.lit("</tr>"))
    said = warnings.groupBy(key).agg(_ordered("code", line("code", "message"), "").alias("w"))
    made = quality.groupBy(key).agg(_ordered("metric", line("metric", "value"), "").alias("q"))
    none = F.lit("<tr><td>none</td></tr>")
    joined = made.join(said, key, "full")
    return joined.select(key, F.concat(F.lit("<h1>Report</h1><table>"), F.coalesce("w", none), F.lit("</table><table>"), F.coalesce("q", none), F.lit("</table>")).alias("report"))


# The only algorithms that an encryption file may name, both for fonts.
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def protected(encryption: Column) -> Column:
    """Whether an encryption file names anything but font obfuscation."""
    found = F.regexp_extract_all(encryption, F.lit(r"""Algorithm=["']([^"']*)["']"""), F.lit(1))
    return F.exists(found, lambda a: ~a.isin(*FONT_ALGORITHMS))


def navigation_entries(elements: DataFrame) -> DataFrame:
    """pkg, ord, href, label of list items of navigation elements in flattened rows (pkg, node, parent, name, attributes, text)."""
    parents = elements.select("pkg", F.col("node").alias("parent"), F.col("name").alias("parent_name"))
    links = elements.where((F.col("name") == "a") & F.col("attributes").getItem("href").isNotNull()).join(parents, ["pkg", "parent"])
    return links.where("parent_name = 'li'").select("pkg", F.col("node").alias("ord"), F.col("attributes").getItem("href").alias("href"), X.collapse(F.col("text")).alias("label"))


def unified_diff(before: Column, after: Column, names: tuple[str, str] = ("before", "after")) -> Column:
    """Unified diff of two texts."""

    def diff(a: str | None, b: str | None) -> str:
        import difflib

        return "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), *names))

    return F.udf(diff, "string", useArrow=True)(before, after)


def audit_table(patches: DataFrame, key: str) -> DataFrame:
    """key, markup: rows of applied corrections (key, seq, original, replacement, confidence, reason)."""
    cells = [F.concat(F.lit("<td>"), X.escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("original", "replacement", "confidence", "reason")]
    return patches.groupBy(key).agg(_ordered("seq", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")), "").alias("markup"))
