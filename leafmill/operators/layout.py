"""Operators on lines with a geometry: spacing, reflow, bands, columns, rosters, rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LIST_START = r"^\s*(?:[•●▪*]|[-–—]|\d+[.)])\s+"
def _page():
    return Window.partitionBy("doc_id").orderBy("pos")



def _near(a: str, b: str) -> Column:
    """Sizes within 10 % of the first."""
    return F.abs(F.col(a) - F.col(b)) < F.col(a) * 0.1


def line_spacing(lines: DataFrame) -> DataFrame:
    """doc_id, spacing: median step between neighbouring lines of like size, from 0.7 to 2.2 of the size; 0 if none."""
    stepped = lines.withColumn("step", F.lead("baseline").over(_page()) - F.col("baseline")).withColumn("next_size", F.lead("size").over(_page()))
    good = (F.col("step") > 0.7 * F.col("size")) & (F.col("step") < 2.2 * F.col("size")) & _near("size", "next_size")
    return stepped.groupBy("doc_id").agg(F.coalesce(F.median(F.when(good, F.col("step"))), F.lit(0.0)).alias("spacing"))


def right_margins(lines: DataFrame) -> DataFrame:
    """Lines with ``margin``: the rightmost end of lines of like size that overlap them.

    Few shapes of lines occur in a document, so shapes are compared, not lines.
    """
    shapes = lines.groupBy("doc_id", "size", "left_x").agg(F.max("right_x").alias("reach"))
    wide = lines.select("doc_id", "size", "left_x", "right_x").distinct()
    b = shapes.select("doc_id", F.col("size").alias("b_size"), F.col("left_x").alias("b_left"), F.col("reach"))
    met = wide.join(b, "doc_id").where(_near("size", "b_size") & (F.col("b_left") < F.col("right_x")) & (F.col("reach") > F.col("left_x")))
    margin = met.groupBy("doc_id", "size", "left_x", "right_x").agg(F.max("reach").alias("margin"))
    return lines.join(margin, ["doc_id", "size", "left_x", "right_x"], "left")


def reflow(lines: DataFrame) -> DataFrame:
    """Lines with the number of their paragraph, ``para``.

    A line goes on with the paragraph of the line before if size and weight stay, the step is a line's, the left edge
    hardly moves, the line before reaches the margin, and the line is no list item.  A row with a null size (an image)
    ends a paragraph.
    """
    full = right_margins(lines).join(line_spacing(lines.where("size is not null")), "doc_id")
    before = {c: F.lag(c).over(_page()) for c in ("size", "bold", "baseline", "left_x", "right_x", "margin")}
    seen = full.withColumns({f"a_{c}": e for c, e in before.items()})
    step, shift = F.col("baseline") - F.col("a_baseline"), F.col("left_x") - F.col("a_left_x")
    joins = (
        _near("a_size", "size")
        & (F.col("a_bold") == F.col("bold"))
        & (F.col("spacing") > 0)
        & (step > 0.7 * F.col("a_size"))
        & (step <= F.col("spacing") * 1.25)
        & (shift >= -2.5 * F.col("a_size"))
        & (shift <= 0.6 * F.col("a_size"))
        & (F.col("a_right_x") >= F.col("a_margin") - 2 * F.col("a_size"))
        & ~F.col("text").rlike(LIST_START)
    )
    marked = seen.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("para", (F.sum("starts").over(_page()) - 1).cast("long")).select(*lines.columns, "para")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, para, text of reflowed lines."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return reflow(lines).groupBy("doc_id", "para").agg(ordered.alias("text"))


def column_ambiguity(lines: DataFrame) -> DataFrame:
    """doc_id, ambiguous: whether lines stand side by side away from the first and last baseline."""
    order = Window.partitionBy("doc_id").orderBy("baseline", "left_x", "right_x", "size")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lines.withColumns(
        {
            "n_base": F.lead("baseline").over(order),
            "n_left": F.lead("left_x").over(order),
            "n_size": F.lead("size").over(order),
            "first": F.first("baseline").over(whole),
            "final": F.last("baseline").over(whole),
        }
    )
    least = F.least("size", "n_size")
    inside = ~((F.abs(F.col("baseline") - F.col("first")) < F.col("size") * 0.25) | (F.abs(F.col("n_base") - F.col("final")) < F.col("n_size") * 0.25))
    clash = inside & (F.abs(F.col("baseline") - F.col("n_base")) < least * 0.25) & (F.col("n_left") - F.col("right_x") > least)
    return seen.groupBy("doc_id").agg(F.bool_or(F.coalesce(clash, F.lit(False))).alias("ambiguous"))


def bands(lines: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, band, n: rows of lines within ``tolerance`` of the baseline of the row's first line."""
    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("baseline")).alias("all"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<long>").alias("sizes"))

    def one(done: Column, line: Column) -> Column:
        same = done["anchor"].isNotNull() & (line - done["anchor"] <= tolerance)
        more = F.concat(F.slice(done["sizes"], 1, F.greatest(F.size(done["sizes"]) - 1, F.lit(0))), F.array(F.element_at(done["sizes"], -1) + 1))
        return F.when(same, F.struct(done["anchor"].alias("anchor"), more.alias("sizes"))).otherwise(
            F.struct(line.alias("anchor"), F.concat(done["sizes"], F.array(F.lit(1).cast("long"))).alias("sizes"))
        )

    folded = gathered.select("doc_id", F.aggregate("all", start, one)["sizes"].alias("sizes"))
    return folded.select("doc_id", F.posexplode("sizes").alias("band", "n")).withColumn("band", F.col("band").cast("long"))


def rosters(rows: DataFrame, size: float) -> DataFrame:
    """doc_id, groups, members of documents that are headed lists of names and roles throughout, else nulls.

    ``rows`` holds bands: doc_id, band, baseline, cells (array of struct(x0, x1, text), one or two).
    """
    one = F.size("cells") == 1
    name = F.col("cells")[0]
    role = F.get("cells", F.lit(1))
    loud = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    order = Window.partitionBy("doc_id").orderBy("band")
    # A heading is a lone line that is not aligned with the names of the section before it.
    seen = rows.withColumn("left", F.last(F.when(~one, name["x0"]), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("heads", one & (F.col("left").isNull() | (F.abs(name["x0"] - F.col("left")) > size * 0.25)))
    seen = seen.withColumn("section", F.sum(F.col("heads").cast("int")).over(order))
    part = Window.partitionBy("doc_id", "section").orderBy("band")
    first = F.min_by(F.when(~F.col("heads"), F.col("cells")), F.when(~F.col("heads"), F.col("band"))).over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = seen.withColumn("first", first).withColumn("step", F.col("baseline") - F.lag("baseline").over(part)).withColumn("nth", F.row_number().over(part))
    left, right = F.col("first")[0], F.get("first", F.lit(1))
    tolerance = size * 0.25
    head_ok = loud(name["text"]) & right.isNotNull() & (right["x0"] - left["x1"] >= size) & (F.abs((name["x0"] + name["x1"]) / 2 - (left["x0"] + right["x1"]) / 2) <= size * 2)
    pair_ok = (F.abs(role["x0"] - right["x0"]) <= tolerance) & (role["x0"] - name["x1"] >= size)
    lone_ok = (F.col("nth") <= 2) | (F.col("step") <= size * 2.5)
    cell_ok = (F.abs(name["x0"] - left["x0"]) <= tolerance) & loud(name["text"]) & (F.size(F.split(F.trim(name["text"]), r"\s+")) <= 10) & F.when(one, lone_ok).otherwise(pair_ok)
    ok = F.coalesce(F.when(F.col("heads"), head_ok).otherwise((F.col("section") > 0) & (F.size("cells") <= 2) & cell_ok), F.lit(False))
    judged = seen.groupBy("doc_id", "section").agg(F.bool_and(ok).alias("ok"), F.count_if(~F.col("heads")).alias("n"), F.count_if(~F.col("heads") & ~one).alias("pairs"))
    whole = judged.groupBy("doc_id").agg(F.bool_and(F.col("ok") & (F.col("n") >= 3)).alias("ok"), F.count("*").alias("groups"), F.sum("n").alias("members"), F.sum("pairs").alias("pairs"))
    good = F.col("ok") & (F.col("pairs") >= 3)
    return whole.select("doc_id", F.when(good, F.col("groups")).alias("groups"), F.when(good, F.col("members")).alias("members"))


def rect_overlaps(rects: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """doc_id, rect, overlaps: whether a rectangle meets any box of its document.

    Both are dealt to horizontal strips of height ``cell``, so the range join becomes an equi-join.
    """
    strips = lambda f: f.withColumn("strip", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    b = strips(boxes).select("doc_id", "strip", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col("x0") < F.col("b_x1")) & (F.col("x1") > F.col("b_x0")) & (F.col("y0") < F.col("b_y1")) & (F.col("y1") > F.col("b_y0"))
    hit = strips(rects).join(b, ["doc_id", "strip"]).where(meets).select("doc_id", "rect").distinct().withColumn("hit", F.lit(True))
    return rects.select("doc_id", "rect").join(hit, ["doc_id", "rect"], "left").select("doc_id", "rect", F.coalesce("hit", F.lit(False)).alias("overlaps"))


def main_spans(spans: DataFrame) -> DataFrame:
    """doc_id, line, pos, text: the longest span of each line, the first of equals."""
    longest = F.max_by(F.struct("pos", "text"), F.struct(F.length(X.strip(F.col("text"))), -F.col("pos")))
    return spans.groupBy("doc_id", "line").agg(longest.alias("s")).select("doc_id", "line", "s.pos", "s.text")


def last_before(events: DataFrame, by: str, at: str, marks: Column) -> DataFrame:
    """Events with ``previous``: the greatest ``at`` of a marked event strictly before (an as-of join as a window)."""
    order = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("previous", F.last(F.when(marks, F.col(at)), ignorenulls=True).over(order))


def line_extents(spans: DataFrame) -> DataFrame:
    """doc_id, line, left_x, right_x of lines from the boxes (x0, x1) of their spans."""
    return spans.groupBy("doc_id", "line").agg(F.min("x0").alias("left_x"), F.max("x1").alias("right_x"))


def ordered_events(events: DataFrame) -> DataFrame:
    """``seq`` of the events of a page (doc_id, page, top, left, pos): by top, then left, equal places by pos."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "left", "pos")))
