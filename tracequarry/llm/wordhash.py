"""Vectorised words and rolling hashes over Arrow text columns.

Words are the maximal runs of bytes other than space and 0x09-0x0D. Everything works on slices of about a
megabyte, so the temporaries of a task stay small whatever the partition size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
NULL_ID = -(2**63)  # stands for a null id inside tasks: it sorts before all others

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
#: Odd multipliers of the byte polynomial and of the two word polynomials.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = _BASES[which]
        inverse = pow(base, -1, 2**64)
        out = []
        for x in (base, inverse):
            a = np.full(size, x, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null row is empty."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: byte range, row and position of each, 64-bit hash, and first word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        base = off[0]
        data, off = data[base : off[-1]], off - base
        n = len(data)
        self.data = data = LOWER[data] if lower else data
        inside = ~SEPARATOR[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = off[(off > 0) & (off < n)]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(off[1:], self.start, "right")
        self.first = np.searchsorted(self.start, off)  # of each row, and the number of words at the end
        self.count = np.diff(self.first)
        self.position = np.arange(len(self.start)) - self.first[self.row] if len(self.start) else np.zeros(0, np.int64)
        p, q = powers(0, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start])

    def windows(self, size: int, lane: int = 1) -> np.ndarray:
        """A hash of each run of size words; runs that leave the row or the slice are of no use."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, U)
        p, q = powers(lane, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((self.hash if lane == 1 else mix(self.hash + U(lane))) * p[:n], out=total[1:])
        return mix((total[size:] - total[:-size]) * q[: n - size + 1])

    def room(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return self.first[self.row + 1] - np.arange(len(self.hash))


def split_blobs(key: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows dealt by key % buckets; each bucket's columns one after another behind their row count."""
    if not len(key):
        return []
    where = (key % U(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    columns = tuple(c[order] for c in columns)
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        out.append((int(b), b"".join([np.int64(hi - lo).tobytes(), *(c[lo:hi].tobytes() for c in columns)])))
    return out


def join_blobs(blobs: list[bytes], *types: type) -> list[np.ndarray]:
    """The columns of many blobs of split_blobs, put together."""
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, t in zip(parts, types, strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]
