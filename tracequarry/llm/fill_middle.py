"""Fill-in-the-middle transformation of whole texts, with cuts between units.

A unit is a run of visible characters with the white space before it; white space at a text's end is a unit too. A text
is never cut into its units: a rolling hash of the last 32 bytes cuts it into chunks where its high bits are zero, so
passages that texts share give the same chunks wherever they stand. A worker remembers, by a chunk's content, how many
units end inside it and where, and whether its borders lie inside a word. Units that go over borders follow from the two
summaries that meet there, counts add up along a text, and a cut is looked up in the one chunk that holds it. Chunking
decides about work only, never about results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import real_id, texts
from .wordhash import NULL_ID, SEPARATOR, U, mix, slices, text_buffers
from .wordhash import ids as id_values

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
GEAR = (mix(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)
CUT_BITS, LEAST, MOST = 8, 64, 4096  # a cut every 2^8 bytes or so
REMEMBERED_BYTES = 32 << 20


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where chunks end: behind a byte whose window hash has CUT_BITS zero bits on top, LEAST bytes or more after the
    last end, and after MOST bytes at the latest."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):  # the window doubles
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)
    out, last = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(last := c)
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


class Summary(NamedTuple):
    """What a chunk tells about itself: do its first and last byte lie in a word, the offsets at which words end inside
    it, its characters, and the characters before each such offset (None: as many as bytes)."""

    opens: bool
    closes: bool
    ends: np.ndarray
    chars: int
    chars_at: np.ndarray | None


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    word = ~SEPARATOR[data]
    ends = (np.flatnonzero(word[:-1] & ~word[1:]) + 1).astype(np.uint16)
    if chunk.isascii():
        return Summary(bool(word[0]), bool(word[-1]), ends, len(data), None)
    chars = np.cumsum(data & 0xC0 != 0x80)
    return Summary(bool(word[0]), bool(word[-1]), ends, int(chars[-1]), chars[ends - 1].astype(np.uint16))


class Memo:
    """Summaries by content. All are forgotten when those held take REMEMBERED_BYTES of chunks."""

    def __init__(self):
        self.known: dict[bytes, Summary] = {}
        self.held = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)  # equal content, not just an equal hash
        if found is None:
            if self.held > REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            found = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
        return found


_memo = Memo()


class Units:
    """The units of a text as sums over its chunks."""

    def __init__(self, raw: bytes, memo: Memo):
        self.bounds = [0, *chunk_ends(np.frombuffer(raw, np.uint8))] if raw else [0]
        self.parts = [memo.of(raw[a:b]) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        after = [x.opens for x in self.parts[1:]] + [False] * bool(self.parts)
        self.upto = [0, *accumulate(len(x.ends) + (x.closes and not o) for x, o in zip(self.parts, after, strict=True))]
        self.chars = [0, *accumulate(x.chars for x in self.parts)]
        self.n = self.upto[-1] + bool(self.parts and not self.parts[-1].closes)

    def end(self, k: int) -> tuple[int, int]:
        """Bytes and characters of the first k units."""
        if k == 0:
            return 0, 0
        if k > self.upto[-1]:  # white space at the end
            return self.bounds[-1], self.chars[-1]
        i = int(np.searchsorted(self.upto, k, "left")) - 1
        part, r = self.parts[i], k - self.upto[i] - 1
        if r == len(part.ends):
            return self.bounds[i + 1], self.chars[i + 1]
        at = int(part.ends[r])
        return self.bounds[i] + at, self.chars[i] + (at if part.chars_at is None else int(part.chars_at[r]))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The first four 32-bit numbers of sha256(`seed:doc_id`) decide: two cuts among the borders of units, whether the text
    is transformed (percent), and whether as spm (spm_percent) or psm. Empty texts and texts that hold a mark stay plain,
    with null lengths. A null text is empty; a null id is hashed as `null`. Rows of one id share the four numbers, equal
    rows have equal results. Texts of any length are cut, other columns of docs may have any names, an empty table gives
    an empty one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, (data, off) = id_values(batch.column(0)), text_buffers(batch.column(1))
            for lo, hi in slices(off):
                rows = [transformed(int(doc[i]), data[off[i] : off[i + 1]].tobytes()) for i in range(lo, hi)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                parts = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi]), *parts[:4], parts[4].cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def transformed(doc: int, raw: bytes) -> tuple:
        units = Units(raw, _memo)
        n = units.n
        key = f"{seed}:{'null' if doc == NULL_ID else doc}"
        h = struct.unpack(">4I", hashlib.sha256(key.encode()).digest()[:16])
        if not raw or h[2] % 100 >= percent or _P in raw or _S in raw or _M in raw:
            return n, "plain", None, None, raw
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        (p, p_chars), (m, m_chars) = units.end(a), units.end(b)
        prefix, middle, suffix = raw[:p], raw[p:m], raw[m:]
        if h[3] % 100 < spm_percent:
            return n, "spm", p_chars, m_chars - p_chars, b"".join((_S, suffix, _P, prefix, _M, middle))
        return n, "psm", p_chars, m_chars - p_chars, b"".join((_P, prefix, _S, suffix, _M, middle))

    out = texts(docs, id_col, text_col).mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. The marks stand in it once each, as no transformed text holds
    one and they can't overlap."""
    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, a, -1), b, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
