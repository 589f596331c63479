"""Byte-level BPE by a monoid tree reduction.

Each match of the pattern is encoded by itself: a piece that is a token is that token; any other is halved (at a power
of two) down to single bytes and put together again. The encodings of two neighbours are joined at their boundary: a sequence of
tokens is the encoding of its bytes if and only if each neighbouring pair is the encoding of its own bytes, so only a
window around the boundary is encoded anew. It grows to the left by doubling until the pair at its edge is stable, and
to the right token by token until the next pair is; all tokens outside are then final. Joining is associative, so
halves of any shape give the same tokens.

Where the boundary moves no token but the nearest ones, a join takes a few steps; where it shifts all tokens to its
right, as in runs of one character, it takes a step for each of them, each over a window of a few tokens. So a piece
of n bytes takes O(n log n) steps; pairs, windows and halves that were seen before are remembered, by a task for itself,
so that idle workers hold none of it. A long window is merged through a heap. Decoding concatenates the tokens' bytes up a tree, level by level.

A null text is empty and has no ids. Rows are encoded one by one: null and repeated ids, repeated rows and columns of
any name change nothing, and an empty table gives an empty table. Ranks come from a file whose place is a parameter;
its content is read on the driver and shared, and nothing of it is kept in the package.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Remembered pieces of a task; when it is full it begins anew.
CACHE = 500_000
#: Remembered halves, windows and pairs of a task, each.
PARTS = 100_000
#: Parts of more bytes are remembered for their own piece only.
SHORT_PART = 32
#: Windows of more bytes are merged through a heap.
LONG_WINDOW = 96
#: Rows whose results are held before they go on.
ROWS = 100
#: Neighbours that decoding puts together in one step.
FAN = 16
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.names = {i: t for t, i in ranks.items()}
        self.same = {t: t for t in ranks}  # so that what is remembered refers to one object a token
        self.find = regex.compile(pattern).findall
        self.digits = {t: str(i) for t, i in ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool | tuple[bytes, ...]] = {}  # True if stable, else the encoding of both
        self.halves: dict[bytes, tuple[bytes, ...]] = {}
        self.windows: dict[bytes, tuple[bytes, ...]] = {}
        self.pieces: dict[str, str] = {}

    def merged(self, raw: bytes) -> tuple[bytes, ...]:
        """Tokens of a window: the lowest rank merges first, from the left."""
        known = self.windows.get(raw)
        if known is None:
            same = self.same.__getitem__
            if len(raw) > LONG_WINDOW:
                return tuple(map(same, self._merged_long(raw)))
            if len(self.windows) >= PARTS:
                self.windows.clear()
            known = self.windows[raw] = tuple(map(same, self._merged_short(raw)))
        return known

    def _merged_short(self, raw: bytes) -> list[bytes]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = self.ranks.get
        pairs = [rank(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
        return parts

    def _merged_long(self, raw: bytes) -> list[bytes]:
        n, rank = len(raw), self.ranks.get
        ends = list(range(1, n + 1))  # where the token that begins here ends; 0: none begins here
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, j, end = heappop(queue)
            if ends[i] != j or j >= n or ends[j] != end:
                continue  # one of the two has merged meanwhile
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(raw[i : ends[end]])) is not None:
                    heappush(queue, (r, i, end, ends[end]))
            h = before[i]
            if h >= 0 and (r := rank(raw[h:end])) is not None:
                heappush(queue, (r, h, i, end))
        out, i = [], 0
        while i < n:
            out.append(raw[i : ends[i]])
            i = ends[i]
        return out

    def pair(self, a: bytes, b: bytes) -> bool | tuple[bytes, ...]:
        """True if (a, b) is the encoding of its own bytes, else that encoding."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PARTS:
                self.pairs.clear()
            found = self.merged(a + b)
            found = self.pairs[a, b] = found == (a, b) or found
        return found

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of left's bytes and right's, from their encodings."""
        if not left or not right:
            return left + right
        known, pair = self.pairs.get, self.pair
        last, token = left[-1], right[0]
        middle = known((last, token)) or pair(last, token)
        if middle is True:
            return left + right
        out, j, n = list(left), 0, len(right)
        while True:  # out and the j-th token of right, encoded anew from the i-th last token of out on
            i = 1
            while i < len(out) and (known((out[-i - 1], middle[0])) or pair(out[-i - 1], middle[0])) is not True:
                i = min(2 * i, len(out))
                middle = self.merged(b"".join(out[-i:]) + right[j])
            out[-i:] = middle
            j += 1
            if j == n:
                break
            middle = known((out[-1], right[j])) or pair(out[-1], right[j])
            if middle is True:  # nothing changes from here on
                out += right[j:]
                break
        return tuple(out)

    def tree(self, raw: bytes, whole: bool = True) -> tuple[bytes, ...]:
        """The tokens of a piece (with whole: a token as such is itself, however it would merge)."""
        if whole and raw in self.ranks:
            return (raw,)
        return self._reduced(raw, {})

    def _reduced(self, raw: bytes, own: dict[bytes, tuple[bytes, ...]]) -> tuple[bytes, ...]:
        """Halved down to single bytes and joined. own: long parts of this piece, so that a periodic one is cheap."""
        if len(raw) < 2:
            return (raw,) if raw else ()
        known = self.halves if len(raw) <= SHORT_PART else own
        found = known.get(raw)
        if found is None:
            half = 1 << (len(raw) - 1).bit_length() - 1  # the same beginnings give the same parts
            a, b, get = raw[:half], raw[half:], self.halves.get
            found = self.join(get(a) or self._reduced(a, own), get(b) or self._reduced(b, own))
            if len(self.halves) >= PARTS:
                self.halves.clear()
            known[raw] = found
        return found

    def piece(self, piece: str) -> str:
        """Ids of a piece as decimal text."""
        ids = ",".join(map(self.digits.__getitem__, self.tree(piece.encode())))
        if len(piece) < 64:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.joined(text).split(",")] if text else []

    def joined(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        known, make = self.pieces.get, self.piece
        return ",".join([known(p) or make(p) for p in self.find(text)])

    def decode(self, ids: list[int]) -> bytes:
        return concatenated([self.names[i] for i in ids])


def concatenated(parts: list[bytes]) -> bytes:
    """Neighbours put together up a tree, FAN at a time, level by level."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return parts[0] if parts else b""


def unreachable(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens that merging their own bytes doesn't give; a piece that equals one is still that token."""
    b = Bpe(ranks, ".")
    return [t for t in ranks if b.tree(t, whole=False) != (t,)]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array<int>, null unless with_ids), ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 (of the bytes that decoding gives), round_trip (do they equal the text's?)."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(*shared.value)
        names = {i: t for t, i in bpe.digits.items()}
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_())
        for batch in (given.slice(lo, ROWS) for given in batches for lo in range(0, given.num_rows, ROWS)):
            out: list[tuple] = []
            for x in batch.column(1):
                text = x.as_py() or ""
                joined = bpe.joined(text)
                parts = joined.split(",") if joined else []
                raw = concatenated(list(map(names.__getitem__, parts)))
                out.append((len(parts), np.array(list(map(int, parts)), np.int32) if with_ids else None, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == text.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip"])

    return texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")
