"""Flat numpy kernels over the text buffer of an Arrow batch.

Texts are handled whole and together: words are found by a mask over all bytes
of a batch, and hashed by one running sum, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import functools
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Memory that a worker may hold on to between pieces of work; taking it anew from the system costs time.
KEPT_BYTES = 450 << 20


def _resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * mmap.PAGESIZE
    except OSError:
        return KEPT_BYTES + 1


def give_back() -> None:
    """Return freed memory to the system if it is much: Python workers live on between tasks, beside the executor's heap."""
    if _resident() > KEPT_BYTES:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, max(16, int(n).bit_length()))
    return up[: n + 1], down[: n + 1]


def unique(h: np.ndarray, first: bool = False) -> tuple[np.ndarray, ...]:
    """Ascending distinct numbers (uint64), and the number of each entry among them; ``first``: and the first entry of each.

    One plain sort of hashes with their places in the lower bits, several times as
    fast as a sort of places. Where two differ in those lower bits alone, places are sorted.
    """
    bits = np.uint64(max(len(h) - 1, 1).bit_length())
    place = np.arange(len(h), dtype=np.uint64)
    if len(h) and not int(h.max()) >> int(64 - bits):
        order, cut = h << bits, np.uint64(0)
    else:
        order, cut = h >> bits << bits, bits
    order |= place
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    # ``take`` is faster than an index, and faster still where it need not check
    value, new = h.take(order, mode="clip") if len(h) else h, np.ones(len(h), bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    distinct = value[new]
    if cut and ((distinct[1:] ^ distinct[:-1]) >> cut == 0).any():
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
        return (distinct, which.astype(np.int32), at)[: 2 + first]
    which = np.empty(len(h), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return (distinct, which, order[new]) if first else (distinct, which)


#: Bytes of a word that ``spellings`` reads eight by eight.
MOST_EIGHTS = 64
#: Values that one running sum covers; it bounds the tables of powers and the sums in memory.
SPAN = 1 << 18


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray, base: int, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial of values[s:e] for each of many spans in ascending order, which may overlap; not finalised.

    values are 64-bit, or numbers of rows of ``table``. Spans are taken by
    stretches, each by one running sum; a longer span than SPAN is one stretch.
    """
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        lo = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, lo + SPAN, "right")))
        n = int(e[j - 1]) - lo
        up, down = powers(base, n)
        part = values[lo : lo + n]
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((part if table is None else table[part]) * up[:n], out=run[1:])
        first = s[i:j] - lo
        out[i:j] = (run[e[i:j] - lo] - run[first]) * down[first]
        i = j
    return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows so that each holds about ``limit`` bytes of text, one whole text at least."""
    for batch in batches:
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            give_back()
            yield batch.slice(i, j - i)
            i = j


def lower_case(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


@dataclass
class Words:
    """Words of a batch: hash, row, and byte range in ``data`` of each."""

    data: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Words of row i: first[i] to first[i + 1].
    first: np.ndarray


def words(raw: np.ndarray, off: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row; lower: with A-Z lower-cased; unless hashed, only where they are."""
    data = lower_case(raw) if lower else raw
    n, rows = len(data), len(off) - 1
    # neither a blank nor one of the five bytes from 0x09
    solid = (data != 0x20) & (data - np.uint8(9) > 4)
    # changes are begins and ends in turn; where two rows join inside a word there are both
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    join = np.unique(off[(off > 0) & (off < n)])
    join = join[solid[join] & solid[join - 1]]
    turn = np.insert(turn, np.repeat(np.searchsorted(turn, join), 2), np.repeat(join, 2))
    if n:
        turn = np.r_[turn[:0] if not solid[0] else 0, turn, turn[:0] if not solid[-1] else n]
    s, e = turn[::2].copy(), turn[1::2].copy()
    h = mix(span_hashes(data, s, e, _P, _BYTE) + (e - s).astype(np.uint64)) if hashed else np.zeros(0, np.uint64)
    first = np.searchsorted(s, off)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, h, row, s, e, first)


def hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words given one after another, equal to those of ``words``."""
    e = np.cumsum(size)
    return mix(span_hashes(data, e - size, e, _P, _BYTE) + size.astype(np.uint64))


#: The first bytes of eight, by how many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spellings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words at ascending places, eight bytes at a time: for many short words faster than ``hashes``, whose values are others."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix((eight[start] & _FIRST.take(size, mode="clip")) + size.astype(np.uint64) * np.uint64(_Q))
    for k in range(8, MOST_EIGHTS, 8):
        at = np.flatnonzero(size > k)
        if not len(at):
            return out
        out[at] = mix(out[at] * np.uint64(_P) + (eight[start[at] + k] & _FIRST.take(size[at] - k, mode="clip")))
    at = np.flatnonzero(size > MOST_EIGHTS)
    out[at] = mix(span_hashes(data, start[at], start[at] + size[at], _P, _BYTE) + size[at].astype(np.uint64))
    return out


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one row, and the index of its first word."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[: n - size + 1] == w.row[size - 1 :])
    return mix(span_hashes(w.hash, at, at + size, _Q)), at


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first[i], first[i] + 1, ... count[i] numbers each, one after another."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)
