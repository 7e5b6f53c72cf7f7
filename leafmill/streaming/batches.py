"""Review of page batches as a resumable stream.

Each micro-batch plans page batches, leaves out those with a completed result for the same input, gives the rest to
a reviewer and appends results.  A failed reviewer marks its batches ``paused``; they are taken up again by the next
run, completed ones are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import plan_batches, remaining

RESULT = "doc_id long, batch long, start_page long, end_page long, input_sha string, status string, applied long, rejected long, cost double, error string"

#: Gets (doc_id, batch, text) and gives (applied, rejected, cost).
Reviewer = Callable[[int, int, str], tuple[int, int, float]]


def review(plan: DataFrame, pages: DataFrame, reviewer: Reviewer, size: int) -> DataFrame:
    """Results of all planned batches."""
    keyed = pages.withColumn("batch", (F.floor((F.col("page") - 1) / size) + 1).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    texts = keyed.groupBy("doc_id", "batch").agg(text.alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                head = (r.doc_id, r.batch, r.start_page, r.end_page, r.input_sha)
                try:
                    rows.append((*head, "completed", *reviewer(r.doc_id, r.batch, r.text), None))
                except Exception as error:  # noqa: BLE001  any failure of an outside reviewer pauses its batch only
                    rows.append((*head, "paused", 0, 0, 0.0, str(error)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return plan.join(texts, ["doc_id", "batch"]).select("doc_id", "batch", "start_page", "end_page", "input_sha", "text").mapInPandas(run, RESULT)


def stored(spark: SparkSession, results: str) -> DataFrame:
    try:
        return spark.read.schema(RESULT).parquet(results)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], RESULT)


def review_stream(spark: SparkSession, pages: str, results: str, checkpoint: str, reviewer: Reviewer, size: int = 10) -> StreamingQuery:
    """Review all pages (doc_id, page, text) that have arrived in a folder, then stop; call again to resume."""

    def step(frame: DataFrame, _: int) -> None:
        session = frame.sparkSession
        plan = remaining(plan_batches(frame, size), stored(session, results))
        review(plan, frame, reviewer, size).write.mode("append").parquet(results)

    stream = spark.readStream.schema("doc_id long, page long, text string").parquet(pages)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(spark: SparkSession, pages: DataFrame, results: str, reviewer: Reviewer, size: int = 10) -> None:
    """Take up paused and missing batches of stored pages."""
    plan = remaining(plan_batches(pages, size), stored(spark, results))
    review(plan, pages, reviewer, size).write.mode("append").parquet(results)
