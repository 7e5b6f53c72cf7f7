"""Guarded corrections and resumable batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINK = r"https?://[^\s)>]+"


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal; of an empty one, as many as there are places."""
    return F.when(part == "", F.length(text) + 1).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def verdict(text: Column, original: Column, replacement: Column, confidence: Column, least: float) -> Column:
    """``applied``, or the first guardrail that a correction fails."""
    links = lambda x: F.regexp_extract_all(x, F.lit(_LINK), F.lit(0))
    return (
        F.when(original.isNull() | replacement.isNull(), "not strings")
        .when(confidence.isNull() | (confidence < least), "confidence")
        .when(occurrences(text, original) != 1, "occurrence count")
        .when(F.contains(original, F.lit("![")) | F.contains(replacement, F.lit("![")) | F.contains(replacement, F.lit("ASSET_PATH_REDACTED")), "image reference")
        .when(links(original) != links(replacement), "external link")
        .when(F.length(replacement) > F.length(original) * 1.5 + 20, "expansion")
        .otherwise("applied")
    )


def apply_patches(text: Column, patches: Column, least: float) -> Column:
    """Fold an ordered array of struct(original, replacement, confidence) into a text.

    Each correction is judged on the text that the ones before it left.  Struct of ``text`` and ``verdicts``.
    """
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("verdicts"))

    def one(done: Column, p: Column) -> Column:
        said = verdict(done["text"], p["original"], p["replacement"], p["confidence"], least)
        after = F.when(said == "applied", F.replace(done["text"], p["original"], p["replacement"])).otherwise(done["text"])
        return F.struct(after.alias("text"), F.concat(done["verdicts"], F.array(said)).alias("verdicts"))

    return F.aggregate(patches, start, one)


def plan_batches(pages: DataFrame, size: int) -> DataFrame:
    """doc_id, batch, start_page, end_page, input_sha of consecutive groups of ``size`` pages (doc_id, page, text)."""
    batch = (F.floor((F.col("page") - 1) / size) + 1).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    grouped = pages.withColumn("batch", batch).groupBy("doc_id", "batch")
    return grouped.agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.sha2(F.concat(F.trim(joined), F.lit("\n")), 256).alias("input_sha"))


def remaining(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Batches without a completed result for their very input."""
    done = results.where(F.col("status") == "completed").select("doc_id", "batch", "input_sha")
    return plan.join(done, ["doc_id", "batch", "input_sha"], "left_anti")


def changed_parameters(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """job, changed: names of parameters that differ from the stored state (nulls are equal)."""
    b = now.select("job", *[F.col(k).alias(f"now_{k}") for k in keys])
    differ = F.filter(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"now_{k}")), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    return stored.join(b, "job").select("job", differ.alias("changed"))


def audit(results: DataFrame) -> DataFrame:
    """doc_id, applied, rejected, cost: totals over batches; the cost is null where it is zero."""
    return results.groupBy("doc_id").agg(F.sum("applied").alias("applied"), F.sum("rejected").alias("rejected"), F.nullif(F.sum("cost"), F.lit(0.0)).alias("cost"))


def records(judged: DataFrame, batch: str, order: str) -> DataFrame:
    """``applied`` and ``rejected``: the corrections (order, verdict) of each batch, as many as its size allows."""
    row = F.struct(order, "verdict")
    kept = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, row)))
    return judged.groupBy(batch).agg(kept(F.col("verdict") == "applied").alias("applied"), kept(F.col("verdict") != "applied").alias("rejected"))


def capped(corrections: DataFrame, batch: str, order: str, most: int = 80) -> DataFrame:
    """The first ``most`` (1 to 200) corrections of each batch: what a request asks a reviewer for."""
    if not 1 <= most <= 200:
        raise ValueError("from 1 to 200 corrections can be asked for")
    return corrections.withColumn("_n", F.row_number().over(Window.partitionBy(batch).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def union_in_order(lists: list[DataFrame]) -> DataFrame:
    """Rows of all lists with ``part``, the number of their list."""
    return reduce(DataFrame.unionByName, [frame.withColumn("part", F.lit(k)) for k, frame in enumerate(lists)])
