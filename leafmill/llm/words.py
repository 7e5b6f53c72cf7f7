"""Vectorised word scanning over Arrow text batches.

Words are maximal runs of bytes of one class in the UTF-8 form of a text.  All classes used here treat every
byte of a multi-byte character alike, so byte runs and character runs agree.  Work goes in chunks of about
``CHUNK`` bytes of text, so memory follows the chunk (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
#: Longer words are hashed one by one, which keeps the polynomial short.
LONG = 64

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_RI = _U(pow(int(_R), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_factor_rng = np.random.default_rng(20240301)
_factors: list[np.uint64] = []
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Stands for the empty word, which is never found in a text.
EMPTY = _U(0x5851F42D4C957F2D)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD_BYTES = FOLD.tobytes()

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            for k, base in enumerate((_R, _RI)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offs


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row makes a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry than rows).

    ``offs`` begins at 0 and ends at ``len(data)``.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[offs < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of words; ``fold`` takes A-Z as a-z."""
    n = len(starts)
    out = np.empty(n, np.uint64)
    byte = _BYTE[FOLD] if fold else _BYTE
    short_ends = np.minimum(ends, starts + LONG)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CHUNK)))
            a, b = starts[lo], short_ends[hi - 1]
            up, down = _power(int(b - a) + 1)
            sums = np.empty(int(b - a) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(byte[data[a:b]] * up[:-1], out=sums[1:])
            s = starts[lo:hi] - a
            size = short_ends[lo:hi] - starts[lo:hi]
            out[lo:hi] = (sums[s + size] - sums[s]) * down[s] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
            lo = hi
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG):
        word = data[starts[i] : ends[i]]
        out[i] = xxhash.xxh3_64_intdigest((FOLD[word] if fold else word).tobytes())
    return out


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` consecutive entries (``len - width + 1`` of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, factor(64 + width), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += hashes[j : j + n] * factor(j)
    return mix(out)


def factor(j: int) -> np.uint64:
    """The j-th odd multiplier of :func:`combine`; without any pattern in j, or reordered words would collide."""
    while len(_factors) <= j:
        _factors.append(_U(_factor_rng.integers(0, 1 << 63, dtype=np.uint64) * _U(2) + _U(1)))
    return _factors[j]
