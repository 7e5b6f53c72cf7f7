"""Language identification by word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls back to its character n-grams, from
the longest order down to single characters: the first order of which the model knows any n-gram scores the mean of
their log frequencies.  A text's score is the sum over all its words.

Words and n-grams are told apart by 64-bit hashes; all words of a chunk of texts are looked up together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import bounded_batches, load

_U = np.uint64
#: Characters that are worked on at a time; a longer text is cut between words.
CHUNK = 1 << 19
_OPEN, _CLOSE = ord("<"), ord(">")
_letters: list[np.ndarray] = []


@dataclass
class Order:
    """Entries of one order (0: words): sorted hashes, and for each the languages that have it with the gain over not having it."""

    keys: np.ndarray
    begins: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray


@dataclass
class LanguageModel:
    """Languages in order, and the entries of words and of n-grams of 1, 2, ... characters."""

    languages: list[str]
    orders: list[Order]


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


@dataclass
class Words:
    """Words of some texts: code points, starts, ends, the text of each word, and their hashes."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray


def _hash(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by running sums; words longer than W.LONG one by one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = W._power(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(W.mix(points.astype(np.uint64) + _U(1)) * up[:-1], out=sums[1:])
        size = (ends - starts).astype(np.uint64)
        out = W.mix((sums[ends] - sums[starts]) * down[starts] + size * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > W.LONG):
        out[i] = xxhash.xxh3_64_intdigest(points[starts[i] : ends[i]].tobytes())
    return out


def words_of(texts: list[str]) -> Iterator[Words]:
    """Lower-case runs of letters of all texts, about ``CHUNK`` characters at a time."""
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def done() -> Words:
        points = np.concatenate(held)
        row = np.repeat(rows, [len(x) for x in held])
        inside = letters()[points]
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        return Words(points, starts, ends, row[starts], _hash(points, starts, ends))

    for i, text in enumerate(texts):
        points = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        while len(points):
            take = len(points)
            if take > 2 * CHUNK:
                gaps = np.flatnonzero(~letters()[points[:CHUNK]])
                take = int(gaps[-1]) + 1 if len(gaps) else CHUNK + int(np.flatnonzero(~letters()[points[CHUNK:]])[0]) + 1
            held.append(points[:take])
            rows.append(i)
            size += take
            points = points[take:]
            if size >= CHUNK:
                yield done()
                held, rows, size = [], [], 0
    if held:
        yield done()


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash of each n-gram of the words between boundary marks; single characters leave the marks out."""
    edge = int(order > 1)
    size = ends - starts + 2 * edge
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) - first[word]
    place = np.clip(starts[word] + at - edge, 0, max(0, len(points) - 1))
    marked = np.where(at < edge, _OPEN, np.where(at >= size[word] - edge, _CLOSE, points[place]))
    value = W.mix(marked.astype(np.uint64) + _U(1))
    whole = np.flatnonzero(at + order <= size[word])
    out = np.full(len(whole), W.factor(100 + order), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(order):
            out += value[whole + j] * W.factor(j)
    return word[whole], W.mix(out)


def _count(batches: Iterator[pa.RecordBatch], orders: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (order 0) and n-grams by language, of rows (lang, text)."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        names, code = np.unique(langs.astype(str), return_inverse=True)
        for found in words_of(batch.column(1).to_pylist()):
            for k in range(len(names)):
                own = np.flatnonzero(code[found.row] == k)
                if not len(own):
                    continue
                keys, at, n = np.unique(found.hashes[own], return_index=True, return_counts=True)
                first = own[at]
                for order in range(orders + 1):
                    if order:
                        word, hashes = grams(found.points, found.starts[first], found.ends[first], order)
                        own_keys, inverse = np.unique(hashes, return_inverse=True)
                        counts = np.bincount(inverse, weights=n[word], minlength=len(own_keys)).astype(np.int64)
                    else:
                        own_keys, counts = keys, n.astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(names[k])] * len(own_keys)), pa.array(np.full(len(own_keys), order, np.int32)), pa.array(own_keys.view(np.int64)), pa.array(counts)],
                        names=["lang", "size", "gram", "n"],
                    )


def fit(rows: DataFrame, orders: int = 4, rows_per_language: int = 3000, seed: int = 17) -> LanguageModel:
    """Learn from ``rows(doc_id, lang, text)``.

    At most about ``rows_per_language`` rows of each language are used, whole texts, chosen by a hash of doc_id (a
    documented bound on the labelled sample; with fewer rows all are used).  Every word and n-gram of these is kept
    with the languages that have it, so the model grows with the sample and not with the square of the languages.
    Rows with a null language, text or doc_id teach nothing; no rows give a model without languages.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, rows_per_language / sizes[lang]) * (1 << 30)))])
    sample = rows.where(draw < shares[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(lambda it: _count(it, orders), "lang string, size int, gram long, n long")
    column = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    got = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).select(column[F.col("lang")].alias("lang"), "size", "gram", "n").toArrow()
    lang = got.column(0).to_numpy().astype(np.int32)
    size, n = got.column(1).to_numpy(), got.column(3).to_numpy()
    gram = got.column(2).to_numpy().view(np.uint64)
    out = []
    for order in range(orders + 1):
        own = np.flatnonzero(size == order)
        own = own[np.lexsort((lang[own], gram[own]))]
        keys, begins = np.unique(gram[own], return_index=True)
        total = np.bincount(lang[own], weights=n[own], minlength=len(languages))
        base = np.log(0.5 / (total + 0.5 * max(1, len(keys))))
        out.append(Order(keys, np.append(begins, len(own)), lang[own], np.log((n[own] + 0.5) / 0.5), base))
    return LanguageModel(languages, out)


def _find(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, at, -1)


def _gains(order: Order, place: np.ndarray, into: np.ndarray, share: np.ndarray, out: np.ndarray) -> None:
    """Add the gains of the entries at ``place``, times ``share``, to rows ``into`` of ``out``."""
    sizes = order.begins[place + 1] - order.begins[place]
    entry = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(order.begins[place], sizes)
    cell = np.repeat(into, sizes) * out.shape[1] + order.lang[entry]
    out += np.bincount(cell, weights=order.gain[entry] * np.repeat(share, sizes), minlength=out.size).reshape(out.shape)


def score_words(model: LanguageModel, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Scores of words in each language, one row per word."""
    out = np.zeros((len(starts), len(model.languages)))
    place = _find(model.orders[0].keys, hashes)
    known = np.flatnonzero(place >= 0)
    out[known] += model.orders[0].base
    _gains(model.orders[0], place[known], known, np.ones(len(known)), out)
    left = np.flatnonzero(place < 0)
    for k in range(len(model.orders) - 1, 0, -1):
        if not len(left):
            break
        word, found = grams(points, starts[left], ends[left], k)
        place = _find(model.orders[k].keys, found)
        word, place = word[place >= 0], place[place >= 0]
        count = np.bincount(word, minlength=len(left))
        hit = np.flatnonzero(count)
        out[left[hit]] += model.orders[k].base
        _gains(model.orders[k], place, left[word], 1 / count[word], out)
        left = left[count == 0]
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, at: int) -> Iterator[pa.RecordBatch]:
    n_langs = len(model.languages)
    for batch in batches:
        total = np.zeros((len(batch), n_langs))
        said = np.zeros(len(batch), bool)
        for found in words_of([x or "" for x in batch.column(at).to_pylist()] if n_langs else []):
            said[found.row] = True
            keys, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
            scores = score_words(model, found.points, found.starts[first], found.ends[first], keys)
            for k in range(n_langs):
                total[:, k] += np.bincount(found.row, weights=scores[inverse, k], minlength=len(batch))
        if n_langs:
            top = total.argmax(axis=1)
            best = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [model.languages[top[i]] if said[i] else "und" for i in range(len(batch))]
        score = np.where(said, best, 0.0) if n_langs else np.zeros(len(batch))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "lang_score"])


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``lang_score`` (the posterior of that language, 0 to 1).

    Row by row, whole texts, no shuffle; a very long text is worked on in parts of about ``CHUNK`` characters.  Null
    or empty text, a text without a letter, or a model without languages: ``und`` with score 0.  Equal scores: the
    language that sorts first.  Repeated rows are judged alike; empty tables give no rows.  Other columns are passed
    through whatever their names, except that the two added ones must be free.
    """
    if taken := {"lang_pred", "lang_score"} & set(documents.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return documents.mapInArrow(lambda it: _predict(it, shared.value, at), schema)


def held_out() -> F.Column:
    """True for the documents that are never learnt from; false where doc_id is null (those teach nothing either)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_documents(documents: DataFrame) -> LanguageModel:
    """A model from the rows that are not held out."""
    return fit(documents.where(~held_out()).select("doc_id", "lang", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_on_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
