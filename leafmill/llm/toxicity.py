"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of a text; each model also gets the
probabilities of the categories before it.  In training these are out-of-fold predictions, so a later model learns
to weigh them as they are on texts that the earlier model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import bounded_batches, load


@dataclass
class Link:
    """One category: hashes of its words (sorted), their weights, weights of earlier log odds, bias, threshold."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float


#: Bytes of the beginnings of longer words that are features beside the words, so inflected and compounded forms count.
STEMS = (4, 5, 6)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word (letters and digits, A-Z as a-z) and of every word's beginnings."""
    starts, ends, word_lo = W.find_words(data, offs, W.ALNUM)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(word_lo))
    rows, hashes = [row], [W.hash_words(data, starts, ends, fold=True)]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        rows.append(row[longer])
        hashes.append(W.hash_words(data, starts[longer], starts[longer] + size, fold=True) ^ W.factor(size))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def word_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its sorted distinct features."""
    flat, offs = W.text_buffers(column)
    for lo, hi in W.chunks(offs):
        rows, hashes = features(flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        order = np.argsort(rows, kind="stable")
        hashes, cuts = hashes[order], np.searchsorted(rows[order], np.arange(hi - lo + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _design(sets: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the words that are present."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.int64)])
    at = np.searchsorted(words, flat)
    at[at == len(words)] = 0
    known = words[at] == flat
    return np.repeat(np.arange(len(sets)), sizes)[known], at[known]


def _choose(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int, least_rows: int = 8) -> np.ndarray:
    """The words that tell a category best by a chi-squared statistic, sorted by hash."""
    flat = np.concatenate([*sets, np.zeros(0, np.int64)])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    n, n1 = weight.sum(), weight[y > 0].sum()
    in_all = np.bincount(at, weights=weight[rows], minlength=len(names))
    in_one = np.bincount(at, weights=(weight * y)[rows], minlength=len(names))
    expected = in_all * n1 / max(n, 1e-9)
    spread = expected * (1 - n1 / max(n, 1e-9)) * (1 - in_all / max(n, 1e-9)) + 1e-9
    score = np.where(count >= least_rows, (in_one - expected) ** 2 / spread, 0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(names[best[score[best] > 25]])


def _train(sets: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, most: int, ridge: float = 1.0, steps: int = 150):
    """Weighted logistic regression by accelerated gradient descent."""
    words = _choose(sets, y, weight, most)
    rows, cols = _design(sets, words)
    k = len(words)
    theta = np.zeros(k + earlier.shape[1] + 1)
    momentum = theta.copy()
    # The step that the largest curvature allows, by power iteration.
    guess, curve = np.ones(len(theta)) / np.sqrt(len(theta)), 0.0
    for _ in range(12):
        z = weight * (np.bincount(rows, weights=guess[cols], minlength=len(sets)) + earlier @ guess[k:-1] + guess[-1])
        guess = np.concatenate([np.bincount(cols, weights=z[rows], minlength=k)[:k], earlier.T @ z, [z.sum()]])
        curve = float(np.linalg.norm(guess))
        guess /= max(curve, 1e-300)
    rate = 1 / (0.3 * curve + ridge)
    for step in range(steps):
        z = np.bincount(rows, weights=momentum[cols], minlength=len(sets)) + earlier @ momentum[k:-1] + momentum[-1]
        slack = weight * (_sigmoid(z) - y)
        grad = np.concatenate([np.bincount(cols, weights=slack[rows], minlength=k)[:k], earlier.T @ slack, [slack.sum()]])
        grad[:-1] += ridge * momentum[:-1]
        after = momentum - rate * grad
        momentum = after + step / (step + 3) * (after - theta)
        theta = after
    return words, theta[:k], theta[k:-1], float(theta[-1])


def _odds(sets: list[np.ndarray], earlier: np.ndarray, words: np.ndarray, weights: np.ndarray, back: np.ndarray, bias: float) -> np.ndarray:
    rows, cols = _design(sets, words)
    return np.bincount(rows, weights=weights[cols], minlength=len(sets)) + earlier @ back + bias


def _threshold(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which F0.7, which counts precision more, is highest on out-of-fold predictions."""
    order = np.argsort(-odds, kind="stable")
    o, hit, all_ = odds[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    total = hit[-1] if len(hit) else 0
    if not total:
        return float("inf")
    score = 1.49 * hit / (all_ + 0.49 * total)
    score[:-1][o[1:] == o[:-1]] = -1
    best = int(score.argmax())
    return float((o[best] + o[best + 1]) / 2) if best + 1 < len(o) else float(o[best])


#: Jaccard similarity of features from which a labelled row is a near copy.
SAME = 0.8


def _distinct(sets: list[np.ndarray]) -> np.ndarray:
    """Rows that are no near copy of an earlier one that stays: met by two signatures, confirmed by their whole sets."""
    keep = np.ones(len(sets), bool)
    seen: list[dict[bytes, list[int]]] = [{}, {}]
    for i, s in enumerate(sets):
        if len(s) < 8:
            continue
        met: list[list[int]] = []
        for known, odd in zip(seen, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
            with np.errstate(over="ignore"):
                values = np.sort(W.mix(s.view(np.uint64) * np.uint64(odd)))[:3].tobytes()
            met.append(known.setdefault(values, []))
        for j in sorted({j for rows in met for j in rows if SAME * len(s) <= len(sets[j]) <= len(s) / SAME}):
            common = len(np.intersect1d(s, sets[j], assume_unique=True))
            if common >= SAME * (len(s) + len(sets[j]) - common):
                keep[i] = False
                break
        if keep[i]:
            for rows in met:
                rows.append(i)
    return keep


def fit(
    documents: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    text: str = "text",
    key: str = "doc_id",
    rows_per_class: int = 5000,
    most_words: int = 2000,
    folds: int = 5,
    seed: int = 29,
) -> list[Link]:
    """Fit a chain in the order of ``categories`` (name -> 0/1 column of ``labels``).

    About ``rows_per_class`` labels with and without the last category are used, chosen by a hash of their key (a
    documented bound on the labelled sample) and weighted to keep their shares.  That few labels are broadcast to
    the documents, of which only those rows go on, as features of their whole texts; near copies among them count
    once.  The model holds at most ``most_words`` words per category.  Null labels, keys and texts
    teach nothing; labels of one key count once, the larger ones.
    """
    bounded_batches(documents.sparkSession)
    marked = labels.select(F.col(f"`{key}`").alias("key"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    names = [f"y{i}" for i in range(len(categories))]
    marked = marked.groupBy("key").agg(*[F.max(n).alias(n) for n in names])
    last = f"y{len(categories) - 1}"
    sizes = {r[0]: r[1] for r in marked.groupBy(last).agg(F.count("*")).collect()}
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))
    share = {k: min(1.0, rows_per_class / n) for k, n in sizes.items()}
    bound = F.lit(0)
    for k, s in share.items():
        bound = F.when(F.col(last) == k, F.lit(int(s * (1 << 30)))).otherwise(bound)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(word_sets(batch.column(0)))
            begins = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(begins, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], names=["words", *names])

    texts = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    drawn = texts.join(F.broadcast(marked.where(draw < bound)), "key").select("text", *names)
    got = drawn.mapInArrow(features, f"words array<long>, {', '.join(f'{n} double' for n in names)}").toArrow()
    lists = got.column(0).combine_chunks()
    flat, begins = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
    labels = np.array([got.column(i + 1).to_numpy() for i in range(len(names))]).reshape(len(names), -1)
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), *labels[:, i]))
    sets, labels = [sets[i] for i in order], labels[:, order]
    keep = np.flatnonzero(_distinct(sets))
    sets, labels = [sets[i] for i in keep], labels[:, keep]
    weight = np.array([1 / share[v] for v in labels[-1]]) if len(keep) else np.zeros(0)
    weight /= weight.mean() if len(weight) else 1
    fold = np.random.default_rng(seed).integers(0, folds, len(sets))
    chain: list[Link] = []
    earlier = np.zeros((len(sets), 0))
    for name, y in zip(categories, labels, strict=True):
        out = np.zeros(len(sets))
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                part = _train([sets[i] for i in inside], earlier[inside], y[inside], weight[inside], most_words)
                out[outside] = _odds([sets[i] for i in outside], earlier[outside], *part)
        words, weights, back, bias = _train(sets, earlier, y, weight, most_words)
        chain.append(Link(name, words, weights, back, bias, _threshold(out, y, weight)))
        earlier = np.column_stack([earlier, np.clip(out, -8, 8)])
    return chain


def _known(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have words; row and number of each distinct feature that is in ``known``."""
    flat, offs = W.text_buffers(column)
    said = np.zeros(len(column), bool)
    pairs = [np.zeros(0, np.int64)]
    for lo, hi in W.chunks(offs):
        rows, hashes = features(flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        said[lo + np.unique(rows)] = True
        if len(known):
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            hit = known[at] == hashes
            pairs.append(np.unique((rows[hit] + lo) * len(known) + at[hit]))
    both = np.concatenate(pairs)
    return said, *np.divmod(both, max(1, len(known)))


def classify(documents: DataFrame, chain: list[Link], text: str = "text") -> DataFrame:
    """All rows and columns with ``p_<category>`` (0 to 1) and ``is_<category>`` for each link of the chain.

    Row by row, whole texts, no shuffle.  Null or empty text: probability 0 and false, as nothing is said.  Other
    columns pass through; the added names must be free.
    """
    added = [f"{p}_{link.category}" for link in chain for p in ("p", "is")]
    if taken := set(added) & set(documents.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    at = documents.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([link.words for link in shared.value]))
        weights = [np.zeros(len(known)) for _ in shared.value]
        for own, link in zip(weights, shared.value, strict=True):
            own[np.searchsorted(known, link.words)] = link.weights
        for batch in batches:
            said, rows, cols = _known(batch.column(at), known)
            earlier = np.zeros((len(batch), 0))
            columns = []
            for own, link in zip(weights, shared.value, strict=True):
                odds = np.bincount(rows, weights=own[cols], minlength=len(batch)) + earlier @ link.earlier + link.bias
                columns += [pa.array(np.where(said, _sigmoid(odds), 0.0)), pa.array((odds >= link.threshold) & said)]
                earlier = np.column_stack([earlier, np.clip(odds, -8, 8)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    fields = [T.StructField(n, T.DoubleType() if n.startswith("p_") else T.BooleanType()) for n in added]
    return documents.mapInArrow(predict, T.StructType([*documents.schema.fields, *fields]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by way of its quality."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, load(spark, sf_dir, "labels"), {"low_quality": (F.col("quality") == 0).cast("int"), "toxic": F.col("toxic")})
    out = classify(docs, chain)
    return out.select("doc_id", F.col("p_low_quality"), F.col("is_low_quality").alias("low_quality"), F.col("p_toxic"), F.col("is_toxic").alias("toxic"))
