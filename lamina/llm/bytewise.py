"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

A text column is one byte buffer with row offsets, so words, lines and their
hashes come from a few NumPy passes over the buffer instead of a Python loop
over words. All multi-byte characters consist of bytes >= 0x80, which makes
byte classes exact for the word classes used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once; one longer text is handled alone

_byte = np.arange(256)
LOWER = _byte.astype(np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
NOT_SPACE = ~SPACE
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of a lower-cased text
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LETTER = ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
NOT_TAIL = (_byte & 0xC0) != 0x80

MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
LONG = 256  # bytes from which a range goes to a digest or a comparison of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, two: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two independent hashes of byte ranges; the second is None unless ``two``.

    Eight bytes at a time go through a bijection of the state, so no algebra of
    positions remains that a text could exploit; long ranges take a digest of 16 bytes.
    """
    size, at = end - start, eights(data)
    one = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    other = mix(size.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) if two else None
    live, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - done
        x = at[start[live] + done] & MASK[np.minimum(left, 8)]
        one[live] = mix(one[live] ^ x)
        if two:
            other[live] = mix(other[live] * np.uint64(0x9FB21C651E98DF25) + x)
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        one[i] = int.from_bytes(digest[:8], "little")
        if two:
            other[i] = int.from_bytes(digest[8:], "little")
    return one, other


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end, two=False)[0]


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at two places are equal, byte by byte."""
    out, x, y = np.ones(len(size), bool), eights(a), eights(b)
    live, done = np.flatnonzero(size > 0), 0
    while len(live) and done < LONG:
        left = size[live] - done
        equal = ((x[at_a[live] + done] ^ y[at_b[live] + done]) & MASK[np.minimum(left, 8)]) == 0
        out[live[~equal]] = False
        live, done = live[equal & (left > 8)], done + 8
    for i in live.tolist():
        out[i] = np.array_equal(a[at_a[i] : at_a[i] + size[i]], b[at_b[i] : at_b[i] + size[i]])
    return out


def contains(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls read as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offs = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and len(array) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(array: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) with at most ``limit`` bytes or one row."""
    data, offs = column(array)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of ``inside`` that stay in one row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    last[offs[1:][offs[1:] > 0] - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines of every row, split at \\n; an empty row has one."""
    cut = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offs, cut, side="right") - 1
    rows = np.arange(len(offs) - 1)
    start = np.concatenate([offs[:-1], cut + 1])
    end = np.concatenate([cut, offs[1:]])
    srow = np.concatenate([rows, row_of])
    erow = np.concatenate([row_of, rows])
    by_start = np.lexsort((start, srow))
    by_end = np.lexsort((end, erow))
    return start[by_start], end[by_end], srow[by_start]


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without white space at both ends; empty ranges become (start, start)."""
    solid = np.flatnonzero(NOT_SPACE[data])
    if not len(solid):
        return start, start.copy()
    i = np.searchsorted(solid, start)
    j = np.searchsorted(solid, end) - 1
    some = i <= j
    a = np.where(some, solid[np.minimum(i, len(solid) - 1)], start)
    return a, np.where(some, solid[np.maximum(j, 0)] + 1, start)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(NOT_TAIL[data], out=out[1:])
    return out


def windows(values: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive values of one row, and the index of their first value."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + values[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[at]), at
