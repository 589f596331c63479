"""Text quality by a generalised additive model with pairwise interactions.

Features are counts and shares of a whole text's bytes, words and lines. Each is cut into bins at training
quantiles. Cyclic boosting fits shallow trees (three leaves on one feature, then four quadrants on a pair) round by
round to the logistic loss and adds them up in one lookup table per feature and per chosen pair; a score is the
logistic of the sum of a text's table entries. Pairs are those whose quadrants explain most of what single features
leave.

Training reads labelled rows with a permitted id, up to `fit_rows` chosen by a hash of the id and the text; what reaches
the driver is their features. Every row's whole text is scored.

Defined results: a null text is empty and scored like an empty one. A score depends on the text alone, so repeated rows
and rows of one id are scored each by its own text. An id with several labels has the largest; labels that are null or
neither 0 nor 1 are none. Rows with a null id are never learned from and not held out. Without training rows, or with
one class, every score is the smoothed share of label 1 (0.5 without rows). An empty table gives an empty table; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import crc_mod, texts
from .toxicity import labelled_sample
from .wordhash import Words, slices, text_buffers

#: Labelled rows that training may read.
FIT_ROWS = 12000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 120, 0.1

FEATURES = (
    "bytes", "words", "lines", "mean_word", "longest_word", "upper", "digit", "stop", "mark", "other_ascii", "high", "space",
    "distinct_words", "same_as_before", "distinct_lines", "marked_words", "capital_words", "short_words", "separator_words", "longest_line",
)
_KIND = np.zeros(256, np.int64)  # 0 lower letters, 1 upper, 2 digit, 3 stop, 4 mark, 5 other ASCII, 6 high, 7 space
_KIND[:128] = 5
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[46, 44, 59, 58]] = 3
_KIND[[33, 35, 36, 37, 38, 42, 63, 64, 124, 94, 126, 61, 43]] = 4
_KIND[128:] = 6
_KIND[[32, 9, 10, 11, 12, 13]] = 7


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of the rows of a slice."""
    rows = len(off) - 1
    words = Words(data, off, lower=False)
    raw = words.data
    size = np.diff(off)
    kind = _KIND[raw]
    row_of_byte = np.repeat(np.arange(rows), size)
    counts = np.bincount(row_of_byte * 8 + kind, minlength=rows * 8).reshape(rows, 8)
    n = words.count
    some = np.maximum(n, 1)
    length = words.end - words.start
    row = words.row
    per_row = lambda x: np.bincount(row, x, rows) if len(row) else np.zeros(rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    if len(row):
        order = np.lexsort((words.hash, row))
        h, r = words.hash[order], row[order]
        distinct = np.bincount(r[np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]], minlength=rows)
        same = np.bincount(row[1:][(words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])], minlength=rows)
        last, first = _KIND[raw[words.end - 1]], _KIND[raw[words.start]]
    else:
        distinct = same = np.zeros(rows)
        last = first = np.zeros(0, np.int64)
    lines = np.bincount(row_of_byte[raw == 10], minlength=rows) + 1
    # a line's words stand for the line: equal word sequences are equal lines
    distinct_lines, longest_line = np.ones(rows), np.zeros(rows)
    if len(row):
        breaks = np.cumsum(raw == 10)
        line = breaks[words.start]
        new = np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])]
        begin = np.flatnonzero(new)
        position = np.arange(len(row)) - begin[np.cumsum(new) - 1]
        key = np.add.reduceat(words.hash * (2 * position + 1).astype(np.uint64), begin)
        owner = row[begin]
        order = np.lexsort((key, owner))
        k, o = key[order], owner[order]
        distinct_lines = np.bincount(o[np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]], minlength=rows) / np.maximum(np.bincount(owner, minlength=rows), 1)
        np.maximum.at(longest_line, owner, np.diff(np.r_[begin, len(row)]))
    bytes_ = np.maximum(size, 1)
    return np.c_[
        np.log1p(size), np.log1p(n), np.log1p(lines), per_row(length) / some, longest, counts[:, 1:7] / bytes_[:, None], counts[:, 7] / bytes_,
        distinct / some, same / some, distinct_lines, per_row((last == 4).astype(float)) / some, per_row((first == 1).astype(float)) / some,
        per_row((length <= 3).astype(float)) / some, per_row(((length == 1) & (first == 4)).astype(float)) / some, np.log1p(longest_line),
    ]


class Gam:
    """Lookup tables by feature and pair of features."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.single = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b * PAIR_BINS // (len(self.cuts[j]) + 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.single):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse(b[:, i], i), self.coarse(b[:, j], j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values over ordered bins: the best split, then the best split of a part."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, lo + i + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid in four, its gain over no cut, and the leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            q = []
            for c in (cg, ch):
                x, y, z, t = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
                q.append((x, y - x, z - x, t - y - z + x))
            gain = sum(_gain(*s) for s in zip(*q, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best:
                best = float(gain)
                v = [-s / (r + 1.0) for s, r in zip(*q, strict=True)]
                out = np.zeros_like(g)
                out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    """A model of features x and labels y. Without rows or with one class, scores are the smoothed share."""
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Gam(cuts, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    raw = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.single):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            raw += step[b[:, j]]
    g, h = slopes()
    grid = [model.coarse(b[:, j], j) for j in range(b.shape[1])]
    cell = lambda i, j, v: np.bincount(grid[i] * PAIR_BINS + grid[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    ranked = sorted(combinations(range(b.shape[1]), 2), key=lambda ij: -_quadrants(cell(*ij, g), cell(*ij, h))[0])
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in ranked[:PAIRS]]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(cell(i, j, g), cell(i, j, h))[1]
            t += step
            raw += step[grid[i], grid[j]]
    return model


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(features(data, off[lo : hi + 1]) for lo, hi in slices(off))])


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(*text_buffers(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "tag", "y", "x"])

    sample = labelled_sample(docs, labels, label, F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(False)), fit_rows, id_col, text_col)
    rows = sample.select("doc_id", "tag", "y", "text").mapInArrow(described, "doc_id long, tag long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("tag", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), float).reshape(-1, len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, np.array(rows.column("y").to_pylist(), float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
