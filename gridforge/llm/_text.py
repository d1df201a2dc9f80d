"""Words and word hashes of whole Arrow string columns, without a Python loop over words.

A column's UTF-8 bytes are treated as one array: a table marks white space and differences of that
mask give the word spans. Hashes read eight bytes of every span at a time and mix them in, so spans
of one length up to eight bytes never agree; spans of more than LONG bytes get a digest. No array is
larger than a few numbers a word.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 256
BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64

#: White space of the contracts, and A-Z in lower case.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row and the end) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as overlapping items; past the end stand zeros."""
    return np.ndarray((len(data) + 1,), "V8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the spans, which may overlap."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _U((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    if not len(starts):
        return out
    eights, live, at = _eights(data), np.flatnonzero(size <= LONG), 0
    while len(live):
        part = eights[starts[live] + at].view("<u8") & _LOW[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ part)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=b"%d" % seed).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def same_spans(data: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[first : first + size] and data[second : second + size] are the same bytes."""
    out = np.ones(len(size), bool)
    if not len(size):
        return out
    eights, live, at = _eights(data), np.flatnonzero((size <= LONG) & (first != second)), 0
    while len(live):
        low = _LOW[np.minimum(size[live] - at, 8)]
        same = eights[first[live] + at].view("<u8") & low == eights[second[live] + at].view("<u8") & low
        out[live[~same]] = False
        at += 8
        live = live[same & (size[live] > at)]
    for k in np.flatnonzero((size > LONG) & (first != second)):
        out[k] = np.array_equal(data[first[k] : first[k] + size[k]], data[second[k] : second[k] + size[k]])
    return out


@dataclass
class Words:
    """Words of a column: byte spans, hashes, and the index of each row's first word (and the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which also break where a row begins."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = offsets[:-1][offsets[:-1] < len(inside)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = begin[begin > 0] - 1
    last[cut] = inside[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(column, lower: bool = True, seed: int = 0) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased for the hash."""
    data, offsets = utf8(column)
    starts, ends = spans(~WHITE[data], offsets)
    data = LOWER[data] if lower else data
    return Words(data, starts, ends, span_hashes(data, starts, ends, seed), np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours; len(hashes) - n + 1 of them, rows not yet told apart."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * BASE + hashes[k : k + size]
    return mix(total)


def row_ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams inside rows; a row of 1 to n - 1 words gives one hash of all of them."""
    counts = w.counts()
    row = w.row_of()
    left = np.repeat(w.rows[1:], counts) - np.arange(len(row))
    every = ngrams(w.hashes, n)
    keep = np.flatnonzero(left[: len(every)] >= n)
    out, owner = every[keep], row[keep]
    for size in range(1, n):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            total = np.full(len(rows), _U(size), np.uint64)
            for k in range(size):
                total = total * BASE + w.hashes[w.rows[rows] + k]
            out, owner = np.r_[out, mix(total ^ _U(0xA5A5A5A5A5A5A5A5))], np.r_[owner, rows]
    if len(owner) and np.any(np.diff(owner) < 0):
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def slices(batch: pa.RecordBatch, column: str | int, most: int = 8 << 20):
    """The batch in parts of about ``most`` bytes of text (one row at least). Freed memory goes back to the
    system after the batch, as a worker may then wait for long."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edge = np.cumsum(sizes)
    k = 0
    while k < batch.num_rows:
        base = edge[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(edge, base + most, "right")))
        yield batch.slice(k, stop - k)
        k = stop
    if _trim:
        _trim(0)


#: The allocator's function that gives freed memory back, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
