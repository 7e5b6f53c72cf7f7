"""The fit of operator 3 counts every candidate of every document."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import pii


def _planted(spark, n: int):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        filler = " ".join(rng.choice(["house", "12 345 678 900", "chapter_12_section", "river"], 6))
        own = "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(24, 60))))
        rows.append((i, f'{filler} token = "{own}" {filler}' if i % 2 else filler))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fit_sees_every_document_of_a_long_table(spark):
    """Documents without candidates change nothing, however many there are."""
    few = _planted(spark, 24)
    plain = spark.range(1000, 46_000).select(F.col("id").alias("doc_id"), F.lit("no candidate here").alias("text"))
    assert pii.fit(few.union(plain)) == pii.fit(few)


def test_every_candidate_counts(spark):
    docs = _planted(spark, 50)
    many = docs.union(docs).union(docs)
    want = pii.candidates(pii.base_spans(many)).selectExpr("sum(size(_cand)) AS n").first()["n"]
    found = pii.vectors_of(many)
    assert found.agg(F.sum("n")).first()[0] == want and found.where("n % 3 <> 0").count() == 0


def test_rounded_counts_keep_every_candidate(spark):
    docs = _planted(spark, 200)
    model = pii.fit(docs, vectors=10)
    got = {r["doc_id"]: r["s"] for r in pii.detect(docs, model).select("doc_id", pii.joined("pii_spans").alias("s")).collect()}
    assert sum("secret" in got[i] for i in range(1, 200, 2)) >= 90


def test_rounding_and_the_greatest_count_of_each(spark):
    for bits in (1, 2, 3, 4, pii.EXACT):
        frame = spark.range(0, 300).select(F.col("id").cast("double").alias("v")).select("v", F.expr(pii._rounded("v", bits)).cast("double").alias("r"))
        v, r = np.array(frame.orderBy("v").collect()).T
        tops = {a: v[r == a].max() for a in set(r) if a < 256}
        assert all(pii._tops(np.array([a]), bits)[0] == top for a, top in tops.items())
        assert bits < pii.EXACT or (v == r).all()
