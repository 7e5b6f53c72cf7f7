"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Patterns are windows of ``width`` consecutive benchmark words (a shorter item is one window).  For each pattern
length the block table gives the shift that the last words allow, positions that cannot end an occurrence are
skipped, the suffix block's hash picks a bucket of test patterns, the prefix block's hash thins it out, and the
words themselves are compared.  All cursors of a chunk of texts advance together.
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
from .tables import Scratch, bounded_batches, load, union_all

_U = np.uint64
#: Positions that one cursor covers.
SEGMENT = 256


@dataclass
class PatternSet:
    """Wu-Manber tables for all patterns of one length; a pattern is a place among the words of one buffer."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    suffix_keys: np.ndarray
    suffix_from: np.ndarray
    order: np.ndarray
    prefix: np.ndarray
    #: Lower-cased text of the items, where each of its words lies, and the first word of each pattern.
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    #: Items of pattern k: ``names[item[item_from[k] : item_from[k + 1]]]``.
    names: list[str]
    item: np.ndarray
    item_from: np.ndarray

    def items_of(self, k: int) -> list[str]:
        return [self.names[i] for i in self.item[self.item_from[k] : self.item_from[k + 1]].tolist()]


def _block_hash(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    out = np.full(len(last), _U(block), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(block):
            out += hashes[last - j] * W.factor(j)
    return W.mix(out)


def _text_of(items: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, a line end between them, and where each begins."""
    raw = [(text or "").encode() for _, text in items]
    offs = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return np.frombuffer(b"\n".join([*raw, b""]).translate(W.FOLD_BYTES), np.uint8), offs


def _firsts(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each ``begin`` on, ``count`` of them, and the row that each comes from."""
    row = np.repeat(np.arange(len(begin)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[row], row


def _tables(
    length: int, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray, names: list[str], data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> PatternSet:
    """Tables for the windows of ``length`` words that begin at ``first``; equal windows (equal in the hashes of all their
    words) become one pattern.  ``owner`` is the item of a window as an index to ``names``, -1 for none."""
    order = np.lexsort([hashes[first + j] for j in range(length)])
    new = np.zeros(len(first), bool)
    new[:1] = True
    for j in range(length):
        column = hashes[first[order] + j]
        new[1:] |= column[1:] != column[:-1]
    group = np.cumsum(new) - 1
    pairs = np.unique(np.stack([group, owner[order]], axis=1)[owner[order] >= 0], axis=0)
    item_from = np.searchsorted(pairs[:, 0], np.arange(int(new.sum()) + 1))
    first = first[order][new]
    block = min(2, length)
    bits = int(min(22, max(12, np.ceil(np.log2(max(2, len(first) * length))) + 4)))
    shift = np.full(1 << bits, length - block + 1, np.uint8)
    down = _U(64 - bits)
    for j in range(block, length + 1):
        np.minimum.at(shift, _block_hash(hashes, first + j - 1, block) >> down, length - j)
    suffix = _block_hash(hashes, first + length - 1, block)
    by_suffix = np.argsort(suffix, kind="stable")
    keys, begins = np.unique(suffix[by_suffix], return_index=True)
    prefix = _block_hash(hashes, first + block - 1, block)
    small = lambda x: x.astype(np.int32)
    return PatternSet(
        length, block, bits, shift, keys, np.append(begins, len(first)), small(by_suffix), prefix, data, small(starts), small(ends), small(first), names, small(pairs[:, 1]), item_from
    )


def build_patterns(items: list[tuple[str | None, str | None]], width: int = 10) -> list[PatternSet]:
    """Tables for (item id, text) pairs; a text without words gives no pattern.

    All in arrays: some 60 bytes for each window beside the text, shared by the tables of all lengths.
    """
    data, offs = _text_of(items)
    starts, ends, word_lo = W.find_words(data, offs, W.ALNUM)
    hashes = W.hash_words(data, starts, ends, fold=False)
    sizes = np.diff(word_lo)
    names = sorted({item for item, _ in items if item is not None})
    number = {name: i for i, name in enumerate(names)}
    owner = np.array([-1 if item is None else number[item] for item, _ in items], np.int64)
    out = []
    for n in np.unique(np.minimum(sizes[sizes > 0], width)).tolist():
        rows = np.flatnonzero(np.minimum(sizes, width) == n)
        first, row = _firsts(word_lo[rows], sizes[rows] - n + 1)
        out.append(_tables(n, hashes, first, owner[rows[row]], names, data, starts, ends))
    return out


def search(
    patterns: PatternSet, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_lo: np.ndarray, hashes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed occurrences: index of the last word, and pattern number."""
    m, block = patterns.length, patterns.block
    first, last = word_lo[:-1] + m - 1, word_lo[1:]
    fits = first < last
    first, last = first[fits], last[fits]
    pieces = (last - first + SEGMENT - 1) // SEGMENT
    at = np.repeat(first, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(at + SEGMENT, np.repeat(last, pieces))
    down = _U(64 - patterns.bits)
    stops, codes = [], []
    while len(at):
        code = _block_hash(hashes, at, block)
        step = patterns.shift[code >> down].astype(np.int64)
        stop = step == 0
        if stop.any():
            stops.append(at[stop])
            codes.append(code[stop])
            step[stop] = 1
        at = at + step
        going = at < end
        at, end = at[going], end[going]
    none = np.zeros(0, np.int64)
    if not stops:
        return none, none
    pos, code = np.concatenate(stops), np.concatenate(codes)
    bucket = np.searchsorted(patterns.suffix_keys, code)
    bucket[bucket == len(patterns.suffix_keys)] = 0
    known = patterns.suffix_keys[bucket] == code
    pos, bucket = pos[known], bucket[known]
    sizes = patterns.suffix_from[bucket + 1] - patterns.suffix_from[bucket]
    tests = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(patterns.suffix_from[bucket], sizes)
    pos, which = np.repeat(pos, sizes), patterns.order[tests]
    alike = _block_hash(hashes, pos - m + block, block) == patterns.prefix[which]
    pos, which = pos[alike], which[alike]
    if not len(pos):
        return none, none
    good = np.ones(len(pos), bool)
    theirs = patterns.first[which].astype(np.int64)
    for j in range(m):
        i, k = pos[good] - m + 1 + j, theirs[good] + j
        good[good] = _same_words(data, starts[i], ends[i], patterns.data, patterns.starts[k].astype(np.int64), patterns.ends[k].astype(np.int64))
    return pos[good], which[good]


def _same_words(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether the words of two texts are equal, those of the first one lower-cased, compared byte by byte."""
    same = a_to - a_from == b_to - b_from
    rows = np.flatnonzero(same)
    lo = 0
    while lo < len(rows):
        size = np.cumsum((a_to - a_from)[rows[lo:]])
        hi = lo + max(1, int(np.searchsorted(size, W.CHUNK, "right")))
        part = rows[lo:hi]
        left, row = _firsts(a_from[part], (a_to - a_from)[part])
        right, _ = _firsts(b_from[part], (a_to - a_from)[part])
        differ = W.FOLD[a[left]] != b[right]
        same[part[np.unique(row[differ])]] = False
        lo = hi
    return same


def scan_column(column: pa.Array, sets: list[PatternSet], found: list[set[str]], covered: list[list[tuple[int, int]]]) -> np.ndarray:
    """Add to each row's item ids and covered word ranges; returns each row's number of words."""
    flat, offs = W.text_buffers(column)
    counts = np.zeros(len(offs) - 1, np.int64)
    for lo, hi in W.chunks(offs):
        data = flat[offs[lo] : offs[hi]]
        starts, ends, word_lo = W.find_words(data, offs[lo : hi + 1] - offs[lo], W.ALNUM)
        counts[lo:hi] = np.diff(word_lo)
        if not len(starts):
            continue
        hashes = W.hash_words(data, starts, ends, fold=True)
        for patterns in sets:
            pos, which = search(patterns, data, starts, ends, word_lo, hashes)
            if not len(pos):
                continue
            row = np.searchsorted(word_lo, pos, "right") - 1
            base = word_lo[row]
            for r, a, k in zip(row.tolist(), (pos - base).tolist(), which.tolist(), strict=True):
                found[lo + r].update(patterns.items_of(k))
                covered[lo + r].append((a - patterns.length + 1, a + 1))
    return counts


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of about ``block_bytes`` of text; the driver holds one at a time."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Documents with ``decon_n_words``, ``decon_items`` (sorted ids) and ``decon_spans`` (word ranges of occurrences).

    The benchmark goes to the executors in blocks of ``block_bytes`` of text, and neither the driver nor a task holds
    more than one.  One block: row by row, without a shuffle.  More: each block is a pass that reads the texts and writes
    only what it found, once for each text that has occurrences, by the 128-bit digest of the text; the documents join
    what was found at the end, in one shuffle.  Null or empty text: no words, no items.  Items without words never occur;
    an item with a null id covers words but names no item; repeated ids count once.  Rows with equal text or id are
    treated each for itself, an empty table stays empty, and all columns of the documents are kept, whatever their names
    (the three added ones must be free).
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    if taken := {"decon_n_words", "decon_items", "decon_spans"} & set(documents.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    frame = documents.select(row, F.col(f"`{text}`").alias("_text"))
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        out = _pass(frame, build_patterns(block, width), digest=False)
    else:
        tables, found = Scratch(spark), []
        while block is not None:
            hits = _pass(frame.select("_text"), build_patterns(block, width), digest=True).where(F.size("decon_spans") > 0)
            found.append(tables.keep(hits.groupBy("_lo", "_hi").agg(F.any_value("decon_items").alias("decon_items"), F.any_value("decon_spans").alias("decon_spans"))))
            block, following = following, next(blocks, None)
        each = union_all(found).groupBy("_lo", "_hi")
        met = each.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("decon_items")))).alias("i"), F.flatten(F.collect_list("decon_spans")).alias("s"))
        counted = _pass(frame, [], digest=True).drop("decon_items", "decon_spans").join(met, ["_lo", "_hi"], "left").drop("_lo", "_hi")
        out = counted.mapInArrow(_merged, _found_schema([frame.schema["_row"]]))
    return out.select("_row.*", "decon_n_words", "decon_items", "decon_spans")


def _found_schema(before: list[T.StructField], *longs: str) -> T.StructType:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    added = {"decon_n_words": T.LongType(), "decon_items": T.ArrayType(T.StringType()), "decon_spans": T.ArrayType(span)} | dict.fromkeys(longs, T.LongType())
    return T.StructType([*before, *(T.StructField(name, kind) for name, kind in added.items())])


def _pass(frame: DataFrame, sets: list[PatternSet], digest: bool) -> DataFrame:
    """The rows of a frame with a column ``_text`` (which goes) and what ``sets`` find in it; with ``digest``, also two halves of its digest."""
    tables = frame.sparkSession.sparkContext.broadcast(sets)
    kept = [c for c in frame.columns if c != "_text"]
    halves = ["_lo", "_hi"] if digest else []
    names = [*kept, "decon_n_words", "decon_items", "decon_spans", *halves]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            found: list[set[str]] = [set() for _ in range(len(batch))]
            covered: list[list[tuple[int, int]]] = [[] for _ in range(len(batch))]
            counts = scan_column(texts, tables.value, found, covered)
            items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
            spans = pa.array([[{"start": a, "end": b} for a, b in merge(x)] for x in covered], _SPANS)
            arrays = [*(batch.column(c) for c in kept), pa.array(counts), items, spans]
            if digest:
                flat, offs = W.text_buffers(texts)
                sums = b"".join(xxhash.xxh3_128_digest(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
                arrays += [pa.array(x) for x in np.frombuffer(sums, np.int64).reshape(-1, 2).T.copy()]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frame.mapInArrow(scan, _found_schema([frame.schema[c] for c in kept], *halves))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_row, decon_n_words, items, spans) with nothing for null and ranges that meet made one."""
    for batch in batches:
        items = pa.array([x or [] for x in batch.column(2).to_pylist()], pa.list_(pa.string()))
        spans = [merge([(y["start"], y["end"]) for y in x or []]) for x in batch.column(3).to_pylist()]
        ranges = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), items, ranges], names=["_row", "decon_n_words", "decon_items", "decon_spans"])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated words and items of each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("decon_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return out.select(
        "doc_id",
        F.col("decon_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without an occurrence of any benchmark window, with their own columns."""
    return decontaminate(documents, benchmark).where(F.size("decon_spans") == 0).select(*[F.col(f"`{c}`") for c in documents.columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT dw.r, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, sha256(coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '')) AS h FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, coalesce(named.h, sha256('')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
