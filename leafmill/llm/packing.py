"""Best-fit packing by exact-complement hashing.

Only the number of pieces of each length matters to the plan, so it is made on the driver from at most
``capacity`` counts, however many documents there are.  From the longest length down, the gap beside a piece is
looked up among single, pair and triple sums of the lengths still available; what fits exactly is consumed as
often as the counts allow.  Residual pieces go to the fullest sequence that takes them.  The plan is a list of
patterns with multiplicities; pieces find their place by their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import Scratch, bounded_batches, load
from .words import chunks, text_buffers


@dataclass
class Plan:
    """Runs of places: piece ranks ``[rank, rank + count)`` of a length go to sequences from ``sequence`` on, at ``offset``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


class SumIndex:
    """Available lengths indexed by the sums of one, two and three of them.

    For each sum the index holds the place of the first combination that may still be available, the longest lengths
    first.  Lengths are only ever used up, so a combination that has gone never comes back and places only move on.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        size = len(left)
        self.pairs = np.arange(size) - 1
        self.triples = np.arange(size) - 2

    def _next(self, x: int, other: int, least: int) -> int:
        """The greatest available length from ``x`` down to ``least`` whose complement to ``other`` is available."""
        if x < least:
            return least - 1
        lengths = np.arange(x, least - 1, -1)
        both = np.flatnonzero((self.left[lengths] > 0) & (self.left[other - lengths] > 0) & ((2 * lengths != other) | (self.left[lengths] > 1)))
        return int(lengths[both[0]]) if len(both) else least - 1

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two available lengths of this sum, the pieces ``beside`` being taken."""
        least = (total + 1) // 2
        x = self.pairs[total] = self._next(int(self.pairs[total]), total, least)
        while x >= least:
            parts = (x, total - x, *beside)
            if all(self.left[p] >= parts.count(p) for p in parts):
                return x, total - x
            x = self._next(x - 1, total, least)
        return None

    def triple(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, int, int] | None:
        """Three available lengths of this sum, the pieces ``beside`` being taken."""
        least = (total + 2) // 3
        while self.triples[total] >= least and not (self.left[self.triples[total]] and self.pair(total - int(self.triples[total]))):
            self.triples[total] -= 1
        for x in range(int(self.triples[total]), least - 1, -1):
            if self.left[x] > beside.count(x) and (rest := self.pair(total - x, (x, *beside))):
                return x, *rest
        return None

    def fill(self, gap: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """One, else two, else three available lengths that fill a gap exactly, the pieces ``beside`` being taken."""
        if gap <= 0:
            return None
        if self.left[gap] > beside.count(gap):
            return (gap,)
        return self.pair(gap, beside) or self.triple(gap, beside)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts[length]`` pieces of each length into sequences of ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    plan = Plan()
    index = SumIndex(left)
    #: Room left in open sequences: room -> list of [first sequence, how many, fill].
    open_at: dict[int, list[list[int]]] = {}

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        plan.length.append(length)
        plan.rank.append(int(taken[length]))
        plan.count.append(n)
        plan.sequence.append(sequence)
        plan.offset.append(offset)
        taken[length] += n
        left[length] -= n

    for length in range(capacity, 0, -1):
        while left[length]:
            fill = () if length == capacity else index.fill(capacity - length, (length,))
            if fill is None:
                break
            parts = (length, *fill)
            n = min(int(left[p]) // parts.count(p) for p in set(parts))
            offset = 0
            for p in parts:
                place(p, n, plan.sequences, offset)
                offset += p
            plan.sequences += n
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                stack = open_at[room]
                first, many, fill_at = stack.pop()
                if not stack:
                    rooms[room] = False
                # As many pieces as fit into each sequence of this room.
                each = room // length
                n = int(left[length])
                if n >= many * each:
                    used, deep = many, each
                elif n >= each:
                    used, deep = n // each, each
                else:
                    used, deep = 1, n
                for k in range(deep):
                    place(length, used, first, fill_at + k * length)
                if used < many:
                    open_at.setdefault(room, []).append([first + used, many - used, fill_at])
                    rooms[room] = True
                after = room - deep * length
                if after:
                    open_at.setdefault(after, []).append([first, used, fill_at + deep * length])
                    rooms[after] = True
                continue
            each = capacity // length
            n = int(left[length])
            used, deep = (n // each, each) if n >= each else (1, n)
            for k in range(deep):
                place(length, used, plan.sequences, k * length)
            after = capacity - deep * length
            if after:
                open_at.setdefault(after, []).append([plan.sequences, used, deep * length])
                rooms[after] = True
            plan.sequences += used
    return plan


class _Table:
    """Numbers of 64-bit keys in order of arrival, in a large sorted array and a small one of recent keys."""

    def __init__(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.parts, self.n = [none, none], 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for own, number in self.parts:
            if len(own):
                at = np.searchsorted(own, keys)
                at[at == len(own)] = 0
                hit = own[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that are not in the table."""
        fresh = (keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)
        held = [self.parts[1], fresh]
        large = 4 * (len(held[0][0]) + len(keys)) > len(self.parts[0][0])
        if large:
            held.append(self.parts[0])
        own, number = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.argsort(own, kind="stable")
        merged = (own[order], number[order])
        self.parts = [merged, (own[:0], number[:0])] if large else [self.parts[0], merged]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` entries."""
    if size <= len(array):
        return array
    out = np.zeros((max(size, len(array) * 3 // 2), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


#: Bytes of ASCII letters, of the second halves of Latin-1 letters, and of punctuation that is told apart from letters.
_ASCII, _LATIN, _MARKS = (np.isin(np.arange(256), list(x)) for x in (
    [*range(65, 91), *range(97, 123)], {*range(0x80, 0xC0)} - {0x97, 0xB7}, b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
))


def plain_bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the letters of each word begin and end, and ``data`` with these letters in lower case.

    Only words of Latin-1 letters between ASCII punctuation have such a body; that of any other word is empty, at its
    end.  The words are all of ``data``, in order.
    """
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    letter = _ASCII[data] | latin
    letter[:-1] |= latin[1:]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins[starts] = letter[starts]
    runs = np.flatnonzero(begins)
    count = lambda mask: (total := np.append(np.int32(0), np.cumsum(mask, dtype=np.int32)))[ends] - total[starts]
    letters, marks = count(letter), count(_MARKS[data])
    at = np.searchsorted(runs, starts)
    plain = (np.searchsorted(runs, ends) - at == 1) & (letters + marks == ends - starts)
    begin = ends.copy()
    begin[plain] = runs[at[plain]]
    lower = W.FOLD[data]
    lower[latin & (data < 0x9F)] += 32
    return begin, begin + np.where(plain, letters, 0), lower


class WordEncoder:
    """Token ids of texts, word by word, with a bounded memory of words and of pieces of words.

    For tokenizers that drop white space and mark the end of each pre-token: ASCII white space then separates
    tokens, so a text's ids are those of its words.  A word of Latin-1 letters between ASCII punctuation is the ids
    of these two or three pieces; any other word is given to the tokenizer as it is.  New pieces of letters are
    encoded many at a time and told apart by their end marks.  Known words and pieces are told apart by 64-bit hashes
    and take some 20 to 30 bytes each.
    """

    #: Words whose ids are put together at a time.
    _STEP = 1 << 18

    def __init__(self, path: str, known: int = 300_000):
        # Tasks share the cores; threads of the tokenizer's own would only keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = known
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self, pieces: bool = True) -> None:
        """Drop all known words, and the pieces they are made of if ``pieces``."""
        self.words, self.rows = _Table(), np.zeros((1 << 12, 3), np.int32)
        if not pieces:
            return
        self.pieces = _Table()
        self.flat = np.zeros(1 << 12, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self._add(np.array([W.EMPTY]), np.zeros(1, np.int64), np.zeros(0, np.int64))

    def _add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Pieces with their ids, one after the other."""
        n, used = self.pieces.n, int(self.begin[self.pieces.n])
        self.flat = _grown(self.flat, used + len(ids))
        self.begin = _grown(self.begin, n + len(keys) + 1)
        self.flat[used : used + len(ids)] = ids
        self.begin[n + 1 : n + len(keys) + 1] = used + np.cumsum(sizes)
        self.pieces.add(keys)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Hashes of ranges of ``data``, and those that are no known pieces with their hashes."""
        starts, ends = (np.concatenate(x) for x in zip(*ranges, strict=True))
        keys = np.concatenate([W.hash_words(data, *x, fold=False) for x in ranges])
        keys[starts == ends] = W.EMPTY
        first = np.unique(keys, return_index=True)[1]
        first = first[self.pieces.find(keys[first]) < 0]
        return keys, [data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], keys[first]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Words ``data[starts[i]:ends[i]]``, from the first to the last, with their hashes."""
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        data = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        ends = np.cumsum(ends - starts)
        starts = np.append(0, ends[:-1])
        begin, end, lower = plain_bodies(data, starts, ends)
        letters, new, fresh = self._new(lower, (begin, end))
        lines = [new[i : i + 100] for i in range(0, len(new), 100)]
        ids = np.array([i for x in self._encode([" ".join(x) for x in lines]) for i in x], np.int64)
        last = np.flatnonzero(self.ends[ids])
        assert len(last) == len(new), "the tokenizer does not mark the ends of words"
        self._add(fresh, np.diff(last, prepend=-1), ids)
        around, new, fresh = self._new(data, (starts, begin), (end, ends))
        found = self._encode(new)
        self._add(fresh, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int64))
        n = self.words.n
        self.rows = _grown(self.rows, n + len(starts))
        place = self.pieces.find(around)
        order = np.argsort(keys)
        self.rows[n : n + len(starts)] = np.stack((place[: len(starts)], self.pieces.find(letters), place[len(starts) :]), axis=1)[order]
        self.words.add(keys[order])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, cuts = self.encode_bytes(*text_buffers(pa.array(texts, pa.string())))
        return np.split(ids, cuts[1:-1])

    def encode_bytes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offs[i]:offs[i + 1]]`` one after the other, and where each begins, and the end."""
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        if max(self.words.n, self.pieces.n) > self.known:
            self.forget(self.pieces.n > self.known)
        starts, ends, word_lo = W.find_words(data, offs, W.NOT_SPACE)
        keys, first, inverse = np.unique(W.hash_words(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        place = self.words.find(keys)
        if len(new := np.flatnonzero(place < 0)):
            new = new[np.argsort(first[new])]
            self._learn(data, starts[first[new]], ends[first[new]], keys[new])
            place = self.words.find(keys)
        rows = self.rows[place]
        sizes = (self.begin[rows + 1] - self.begin[rows]).sum(axis=1)[inverse]
        cuts = np.append(0, np.cumsum(sizes))[word_lo]
        out = np.zeros(int(sizes.sum()), np.uint32)
        done = 0
        for lo in range(0, len(inverse), self._STEP):
            at = rows[inverse[lo : lo + self._STEP]].ravel()
            begin = self.begin[at]
            size = self.begin[at + 1] - begin
            after = np.cumsum(size)
            out[done : done + int(after[-1])] = self.flat[np.arange(after[-1]) + np.repeat(begin - (after - size), size)]
            done += int(after[-1])
        return out, cuts


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, WordEncoder] = {}


def cut_into_pieces(documents: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of each document's ids (its tokens, then ``end_id``)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            keys = batch.column(0).to_pylist()
            flat, offs = text_buffers(batch.column(1))
            for lo, hi in chunks(offs, 1 << 19):
                found, cuts = encoder.encode_bytes(flat, offs[lo : hi + 1])
                for key, a, b in zip(keys[lo:hi], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    ids = np.append(found[a:b], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, value in zip(rows, (key, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(pieces, _PIECES)


def _placer(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length, rank = np.array(plan.length, np.int64), np.array(plan.rank, np.int64)
    order = np.lexsort((rank, length))
    keys = (length[order] << 48) | rank[order]
    ranks, sequence, offset = rank[order], np.array(plan.sequence, np.int64)[order], np.array(plan.offset, np.int64)[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, (size << 48) | at, "right") - 1
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence[run] + at - ranks[run]), pa.array(offset[run])], names=[*names, "sequence_id", "offset"]
            )

    return place


def pack(documents: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    The tokens are computed once and the pieces written below the checkpoint folder.  The driver sees one count for
    each length (at most ``capacity``) and the plan, whose size follows the number of distinct lengths, not of
    documents.  Ranks within a length are counted in salted groups, about as many as each holds rows, so a length
    that a third of all documents share is dealt over many tasks.

    Null or empty text: the end id alone, one piece of length 1.  Null or repeated doc_ids: each row is packed as
    a document of its own.  An empty table gives no rows; other columns are not read.  A document of exactly
    ``capacity`` ids is one piece; longer ones are cut and only the last piece may be shorter.
    """
    bounded_batches(documents.sparkSession)
    pieces = Scratch(documents.sparkSession).keep(cut_into_pieces(documents, path, capacity, end_id, text, doc_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    groups = F.create_map(*[F.lit(int(x)) for length, n in counts.items() for x in (length, max(1, round(n**0.5)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups[F.col("length").cast("int")].cast("long")).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(bases, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(plan), f"{_PIECES}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
