"""Vectorised word splitting and hashing over Arrow string columns (numpy only).

Everything here works on whole batches of UTF-8 bytes, so no Python loop runs
per word.  Word classes are byte classes: all bytes of a multi-byte character
are at least 0x80, and both word definitions used by the operators treat those
as word characters, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Words longer than this are hashed one at a time.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and ``n + 1`` offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # more than 2 GB, or no chunk
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each (one row at least), to keep arrays small."""
    _, off = as_bytes(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf`` and, for each row, the range of its words (``n + 1`` offsets)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_in = inside[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = is_in.copy()
    first[1:] &= ~is_in[:-1] | cut[1:n]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _M1)
    if not len(size):
        return h
    wide = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=np.concatenate([buf, np.zeros(9, np.uint8)]).tobytes(), strides=(1,))
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        rest = size[live] - at
        h[live] = mix((h[live] ^ (wide[starts[live] + at] & _MASKS[np.minimum(rest, 8)])) * _M1 + np.uint64(1))
        at += 8
        live = live[rest > 8]
    for k in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        h[k] = np.frombuffer(digest, dtype=np.uint64)[0]
    return h


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive words of a row, and the rows' offsets into them.

    A row of 1 to ``k - 1`` words has one shingle of all its words; an empty row has none.
    """
    count = np.diff(rows)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(made)])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    at = np.arange(off[-1]) + np.repeat(rows[:-1] - off[:-1], made)
    length = np.repeat(np.minimum(count, k), made)
    out = length.astype(np.uint64) * _M3
    for j in range(k):
        live = length > j
        if live.all():
            out = mix(out * _M1 + h[at + j])
        else:
            out[live] = mix(out[live] * _M1 + h[at[live] + j])
    return out, off


def row_hash64(seed: int, parts: np.ndarray) -> np.ndarray:
    """Combines the columns of ``parts`` (n x k, uint64) into one hash a row."""
    out = np.full(len(parts), seed, dtype=np.uint64)
    for j in range(parts.shape[1]):
        out = mix(out * _M1 + parts[:, j])
    return out
