"""Repeated passages by relative Lempel-Ziv parsing.

The reference is made of blocks: every window of ``window`` words that several documents hold, once, at the place
where the smallest of these documents has it first.  A document is parsed from left to right: at the first word whose
block is in the reference a factor begins, and it grows by a word as long as the next block is the one that follows in
the same reference document.  As each block has one place, the longest factor is also the only one, and it is one
passage of its reference.  A factor ends where its passage does.  What then begins is checked at once: the blocks over
the end of a factor are looked up as all others are, so a passage of another reference that overlaps it becomes a
factor too and none is lost.  Every factor is at least a block long; all its words repeat.

The index holds only blocks that can repeat.  Of the ``gram``-word grams of a block the one with the least hash is
its anchor; equal blocks have equal anchors, so blocks whose anchor occurs in one document only are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import Scratch, bounded_batches, load

_U = np.uint64
#: Bits of a text's digest that tell texts of one doc_id apart.
_TAG = 20
_AT = 40


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span : width - span + n])


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of each row."""
    flat, offs = W.text_buffers(batch.column(at))
    for lo, hi in W.chunks(offs):
        data = flat[offs[lo] : offs[hi]]
        starts, ends, word_lo = W.find_words(data, offs[lo : hi + 1] - offs[lo], W.NOT_SPACE)
        hashes = W.hash_words(data, starts, ends, fold=False)
        for k in range(hi - lo):
            yield lo + k, hashes[word_lo[k] : word_lo[k + 1]]


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    lo, hi = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
    return int(lo), int(hi)


def _windows(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and hash of every window."""
    anchors = least_in_windows(W.combine(hashes, gram), window - gram + 1)
    return anchors, W.combine(hashes, window)


def _sign(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, anchors = [], [], []
        for _, hashes in _texts(batch, 1):
            sizes.append(len(hashes))
            digests.append(_digest(hashes))
            anchors.append(np.unique(least_in_windows(W.combine(hashes, gram), window - gram + 1)).view(np.int64))
        begins = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(begins, pa.array(np.concatenate([*anchors, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), lists],
            names=["doc_id", "n_words", "lo", "hi", "anchors"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Blocks whose anchor is shared, with their own place and the first one of an equal block, of rows (doc_id, text, tag, shared)."""
    for batch in batches:
        tags = batch.column(2).to_numpy()
        shared = batch.column(3)
        docs = batch.column(0).to_numpy()
        for row, hashes in _texts(batch, 1):
            if _digest(hashes)[0] & ((1 << _TAG) - 1) != tags[row]:
                continue
            anchors, blocks = _windows(hashes, window, gram)
            at = np.flatnonzero(np.isin(anchors.view(np.int64), shared[row].values.to_numpy()))
            if len(at):
                found = blocks[at]
                _, least, same = np.unique(found, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.full(len(at), docs[row])), pa.array(at | (int(tags[row]) << _AT)), pa.array(at[least[same]])],
                    names=["block", "node", "at", "first"],
                )


def factors_of(starts: np.ndarray, refs: np.ndarray, places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, reference, place) of the sorted starts of indexed blocks.

    A factor is as long as the next block follows in the text and in the reference alike.
    """
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (np.diff(refs) != 0) | (np.diff(places) != 1)))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + window, int(refs[a]), int(places[a])) for a, b in zip(new, last, strict=True)]


def _parse(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Factors of rows (node, tag, found) where found holds (at, ref, place)."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref", "place")]))
    for batch in batches:
        out = []
        for found in batch.column(2):
            at, ref, place = (found.values.field(i).to_numpy() for i in range(3))
            at = at & ((1 << _AT) - 1)
            order = np.argsort(at, kind="stable")
            at, ref, place = at[order], ref[order], place[order]
            once = np.append(True, np.diff(at) != 0)
            out.append([{"start": a, "length": n, "ref": r, "place": p} for a, n, r, p in factors_of(at[once], ref[once], place[once], window)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["node", "tag", "factors"])


_FACTORS = "array<struct<start:long,length:long,ref:long,place:long>>"


def repeated_factors(documents: DataFrame, window: int = 50, gram: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tag, factors`` for every document with words that repeat.

    A factor (start, length, ref, place) says that these ``length`` words also stand in document ``ref`` from word
    ``place`` on; no smaller document holds its blocks.  ``tag`` tells texts of one doc_id apart (bits of the digest of
    the word sequence).  Texts with equal word sequences form a class; a copy of a smaller document is one factor over
    all its words, and only the smallest goes on.  Blocks are grouped by hash with map-side minima, so a passage
    that very many documents share costs one row for each task.  The index is written before documents are joined to
    it, so that both sides of that join come straight from a shuffle and a block of very many documents is split.
    """
    bounded_batches(documents.sparkSession)
    tables = Scratch(documents.sparkSession)
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    signed = tables.keep(rows.mapInArrow(partial(_sign, window=window, gram=gram), "doc_id long, n_words long, lo long, hi long, anchors array<long>"))
    long = signed.where(F.col("n_words") >= window)
    tag = F.col("lo").bitwiseAND(F.lit((1 << _TAG) - 1))
    classes = long.groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.any_value("anchors").alias("anchors"))
    anchors = classes.select("node", tag.alias("tag"), F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("anchor")
    marks = tables.keep(anchors.join(shared, "anchor").groupBy("node", "tag").agg(F.collect_list("anchor").alias("shared")))
    marked = rows.join(marks.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "text", "tag", "shared")
    blocks = marked.mapInArrow(partial(_blocks, window=window, gram=gram), "block long, node long, at long, first long")
    least = blocks.groupBy("block").agg(F.min("node").alias("ref"), F.max("node").alias("top"), F.min_by("first", "node").alias("place"))
    index = tables.keep(least.where("ref < top").select("block", "ref", "place"))
    met = blocks.select("block", "node", "at").join(index, "block").where("ref < node")
    found = met.groupBy("node", F.shiftright("at", _AT).alias("tag")).agg(F.collect_list(F.struct("at", "ref", "place")).alias("found"))
    parsed = found.mapInArrow(partial(_parse, window=window), f"node long, tag long, factors {_FACTORS}")
    ids = long.groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("top"))
    repeated = tables.keep(ids.where("node < top").select("lo", "hi", "node"))
    copies = long.select("doc_id", "n_words", "lo", "hi").join(repeated, ["lo", "hi"]).where("node < doc_id")
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("start"), F.col("n_words").alias("length"), F.col("node").alias("ref"), zero.alias("place")))
    return parsed.withColumnRenamed("node", "doc_id").unionByName(copies.select("doc_id", tag.alias("tag"), whole.alias("factors")).distinct())


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept text of rows (doc_id, text, found) where found holds (tag, factors)."""
    for batch in batches:
        flat, offs = W.text_buffers(batch.column(1))
        found = batch.column(2).to_pylist()
        sizes, removed, kept = [], [], []
        for row in range(len(batch)):
            data = flat[offs[row] : offs[row + 1]]
            words = data.tobytes().split()
            gone = np.zeros(len(words), bool)
            if found[row] and words:
                starts, ends, _ = W.find_words(data, np.array([0, len(data)]), W.NOT_SPACE)
                tag = _digest(W.hash_words(data, starts, ends, fold=False))[0] & ((1 << _TAG) - 1)
                for one in found[row]:
                    if one["tag"] == tag:
                        for f in one["factors"]:
                            gone[f["start"] : f["start"] + f["length"]] = True
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
        )


def remove_repeats(documents: DataFrame, window: int = 50, gram: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; kept: the words that stay, joined by one space.

    Words are runs of characters other than white space, unchanged.  A word goes if a window of ``window`` words that
    covers it also starts in a document with a smaller doc_id; all windows are judged on the input.  Equality of
    64-bit hashes stands for equality of windows.  Null or empty text: no words, an empty text.  Texts shorter than a
    window, and rows with a null doc_id, lose nothing and are no reference.  Rows of one doc_id are not compared with
    each other.  Empty tables give no rows; other columns are not read.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    factors = repeated_factors(documents, window, gram, doc_id, text)
    found = Scratch(documents.sparkSession).keep(factors.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "factors")).alias("found")))
    return rows.join(found, "doc_id", "left").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without passages of 50 words that a smaller document has."""
    out = remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (s) WHERE m < doc_id),
gone_of AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone_of USING (doc_id)
"""
