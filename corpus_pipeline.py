"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; the frame it returns is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language, neardup, packing, pii
from leafmill.llm.tables import ensure_checkpoint_dir, free, load

#: A prediction of less than this posterior is rejected like ``und``.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language; null texts, texts without letters and undecided ones go."""
    out = language.identify(docs, language.fit_on_documents(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*_same(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each class at 80 % of five-word shingles, null ids last.

    Rows are told apart by a digest of doc_id and text, so texts of one doc_id, or without any, are judged one by one
    and only rows of one class, exact copies included, are dropped.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    classes = neardup.near_duplicates(keyed, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = keyed.select("doc_id", "_row").join(classes, "_row").groupBy("component_id").agg(least["_row"].alias("_row")).select("_row")
    return keyed.join(kept, "_row").dropDuplicates(["_row"]).select(*_same(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


def _same(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _freed(stage: Stage) -> Stage:
    """``stage``, with what its predecessors left in the driver collected before it begins."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES: list[tuple[str, Stage]] = [
    ("language", _freed(identify_language)),
    ("near_duplicates", _freed(drop_near_duplicates)),
    ("decontaminate", _freed(drop_contaminated)),
    ("personal_data", _freed(redact_personal_data)),
    ("pack", _freed(pack)),
]

#: Neither a fitted language model nor packing can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
