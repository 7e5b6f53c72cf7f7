"""Operators that must cover whole inputs: rows of one id, shared directions, labelled rows."""

import corpus_pipeline
import numpy as np
import pytest

from leafmill.llm import embeddings, toxicity
from leafmill.llm import words as W


@pytest.mark.parametrize("common,rows", [(0.0, 20_000), (0.6, 1_000_000), (0.8, 1_000_000), (0.95, 20_000)])
def test_tables_for_vectors_that_share_a_direction(spark, common, rows):
    """Codes fitted on off-centre vectors, planned for many rows, find new pairs at a cosine of 0.905."""
    rng = np.random.default_rng(3)
    way = embeddings.unit(rng.standard_normal((1, 64)))

    def draw(n):
        return embeddings.unit(common * way + np.sqrt(1 - common**2) * embeddings.unit(rng.standard_normal((n, 64))))

    table = spark.createDataFrame([(v,) for v in draw(3000).tolist()], "vector array<double>")
    codes = embeddings.fit(table, rows, 0.9, 0.99, sample=rows)
    a = draw(2000)
    for b in (rng.standard_normal(a.shape), draw(2000) - draw(2000)):
        b = embeddings.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
        b = 0.905 * a + np.sqrt(1 - 0.905**2) * b
        assert (codes.keys(a) == codes.keys(b)).any(axis=1).mean() >= 0.97


def test_labelled_rows_go_only_as_near_copies():
    """Rows that share just the features with the least hashes all stay; one that differs in two of a hundred goes."""
    pool = np.unique(np.random.default_rng(6).integers(1, 1 << 62, 8000))
    with np.errstate(over="ignore"):
        least = [np.argsort(W.mix(pool.view(np.uint64) * np.uint64(odd)))[:3] for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    frequent = np.unique(np.concatenate(least))
    rest = np.delete(pool, frequent)
    rows = [np.sort(np.append(pool[frequent], rest[100 * i : 100 * i + 100])) for i in range(50)]
    copy = np.sort(np.append(pool[frequent], np.append(rest[:98], rest[6000:6002])))
    assert toxicity._distinct([*rows, copy]).tolist() == [True] * 50 + [False]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Of each group of near copies one row stays; clean rows stay though their id repeats or is null."""
    text = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcde"]
    rows = [(1, text[0]), (1, text[1]), (2, text[0]), (3, text[2] + " x"), (3, text[2]), (None, text[3]), (None, text[3]), (None, text[4]), (None, text[0]), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()])
    third = [x for x in got if x[0] == 3]
    assert len(third) == 1 and third[0][1].startswith(text[2])
    assert [x for x in got if x[0] != 3] == [(0, text[3]), (0, text[4]), (1, text[0]), (1, text[1]), (4, ""), (5, "")]
