"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts byte triples that two words share in order, each within five bytes and weighted by 1, 1/2 or 1/4
for a span of 3, 4 or 5, so inserted or replaced characters cost weight and don't break a match; it is divided by
both words' norms. Landmarks are training words; the machine is linear in the Nyström features K^(-1/2) k(word).
A decision is then <triples of the word, v> / norm with one weight table v, so scoring costs the same for any
number of landmarks: six lookups a byte.

Words of a text are pooled as its instances (largest decision, decisions above the margin), and a logistic curve
fitted on the training rows turns the pool into a score. Training reads labelled rows with a permitted id, up to
`fit_rows` of them chosen by a hash of the id and the text; what reaches the driver is their words with counts. Every
row's whole text is scored.

Defined results: a null or empty text has no words and gets the score of an empty pool. A score depends on the text
alone, so repeated rows and rows of one id are scored each by its own text. An id with several labels has the largest;
labels that are null or neither 0 nor 1 are none. Rows with a null id are never learned from and not held out. Without
training rows, or with one class, every score is that class's smoothed share (0.05 without rows). An empty table gives
an empty table; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import crc_mod, real_id, tagged
from .wordhash import LOWER, Words, slices, text_buffers

#: Labelled rows that training may read.
FIT_ROWS = 4000
LANDMARKS = 300
GAPS = (((1, 2), 1.0), ((1, 3), 0.5), ((2, 3), 0.5), ((1, 4), 0.25), ((2, 4), 0.25), ((3, 4), 0.25))
POOL = 6

#: 128 kinds of bytes: letters apart, digits and punctuation by kind, and the bytes of other scripts by their low bits.
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = np.arange(1, 27)
_KIND[48:58] = np.arange(27, 37)
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[]_|~"):
    _KIND[_c] = 37 + _i % 25
_KIND[128:192] = 64 + np.arange(64)
_KIND[192:] = 62 + np.arange(64) % 2
_SQUARES = np.zeros(6)
for (_a, _b), _w in GAPS:
    _SQUARES[_b + 1 :] += _w * _w
#: Sum of squared weights of the triples that begin in the first r positions from a word's end.
_TAIL = np.cumsum(_SQUARES)


def _norms(length: np.ndarray) -> np.ndarray:
    return np.sqrt(np.where(length < 6, _TAIL[np.minimum(length, 5)], _TAIL[5] + (length - 5) * _SQUARES[5]))


def decisions(words: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """The decision of each word."""
    if not len(words.start):
        return np.zeros(0)
    kind = _KIND[words.data]
    n = len(kind)
    length = words.end - words.start
    total = np.zeros(n + 1)
    value = np.zeros(n, np.float32)
    room = np.zeros(n, np.int64)
    for k in range(3, 6):  # room at a byte: bytes to its word's end, up to 5
        at = words.end - k
        room[at[at >= words.start]] = k
    far = length > 5
    if far.any():
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, words.start[far], 1)
        np.add.at(edge, words.end[far] - 5, -1)
        room[np.cumsum(edge[:n]) > 0] = 5
    for (a, b), w in GAPS:
        at = np.flatnonzero(room > b)
        if len(at):
            value[at] += np.float32(w) * table[kind[at] << 14 | kind[at + a] << 7 | kind[at + b]]
    np.cumsum(value, out=total[1:])
    norm = _norms(length)
    return np.where(norm > 0, (total[words.end] - total[words.start]) / np.maximum(norm, 1e-9), 0) + bias


def _triples(word: bytes) -> Counter:
    k = _KIND[LOWER[np.frombuffer(word, np.uint8)]].tolist()
    out: Counter = Counter()
    for (a, b), w in GAPS:
        for i in range(len(k) - b):
            out[k[i] << 14 | k[i + a] << 7 | k[i + b]] += w
    return out


def _features(words: list[bytes], columns: dict[int, int]) -> np.ndarray:
    """Normalised triple weights of words over the given triples."""
    out = np.zeros((len(words), len(columns)), np.float32)
    for i, w in enumerate(words):
        norm = float(_norms(np.array([len(w)]))[0])
        for t, x in _triples(w).items():
            j = columns.get(t)
            if j is not None:
                out[i, j] = x / norm
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e6, steps: int = 15) -> tuple[np.ndarray, float]:
    """Squared hinge, by Newton steps on the primal over the words inside the margin."""
    weight = weight / weight.sum()
    u = np.zeros(z.shape[1] + 1)
    ridge = np.full(len(u), 1 / c)
    ridge[-1] = 1e-9
    before = None
    for _ in range(steps):
        h, g, inside = np.diag(ridge), np.zeros(len(u)), []
        for lo in range(0, len(z), 1000):
            x = np.c_[z[lo : lo + 1000], np.ones(len(z[lo : lo + 1000]))].astype(np.float64)
            now = y[lo : lo + 1000] * (x @ u) < 1
            x, w = x[now], weight[lo : lo + 1000][now]
            h += x.T @ (x * w[:, None])
            g += x.T @ (w * y[lo : lo + 1000][now])
            inside.append(now)
        inside = np.concatenate(inside)
        if before is not None and (inside == before).all():
            break
        before = inside
        u = np.linalg.solve(h, g)
    return u[:-1], float(u[-1])


def _pool(words: Words, f: np.ndarray) -> np.ndarray:
    """(rows, POOL): largest decision, number above 0, number above 0.7, the same as shares, number of words."""
    n_rows = len(words.count)
    out = np.zeros((n_rows, POOL))
    out[:, 0] = -2
    full = np.flatnonzero(words.count)
    if len(full):
        begin = words.first[full]
        n = words.count[full]
        hit0, hit1 = (np.add.reduceat((f > s).astype(np.float64), begin) for s in (0.0, 0.7))
        out[full] = np.c_[np.clip(np.maximum.reduceat(f, begin), -2, 2), np.log1p(hit0), np.log1p(hit1), np.sqrt(hit0 / n), np.sqrt(hit1 / n), np.log1p(n) / 5]
    return out


def _pool_of(f: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pool of one text from the decisions and counts of its distinct words."""
    total = n.sum()
    if not total:
        return np.r_[-2.0, np.zeros(POOL - 1)]
    hit0, hit1 = (float(n[f > s].sum()) for s in (0.0, 0.7))
    return np.array([np.clip(f.max(), -2, 2), np.log1p(hit0), np.log1p(hit1), np.sqrt(hit0 / total), np.sqrt(hit1 / total), np.log1p(total) / 5])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
    return w


class Model:
    """table and bias give a word's decision, curve turns a pool into a score; marks and weights are the landmarks and
    the machine's weights on the Nyström features that were folded into the table."""

    def __init__(self, table: np.ndarray, bias: float, curve: np.ndarray, marks: list[bytes] = (), weights: np.ndarray | None = None):
        self.table, self.bias, self.curve, self.marks, self.weights = table, bias, curve, marks, weights

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        words = Words(data, off, lower=True)
        x = _pool(words, decisions(words, self.table, self.bias))
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.curve, -30, 30)))


def word_counts(data: np.ndarray, off: np.ndarray) -> list[tuple[bytes, bytes]]:
    """The distinct words of each text, joined by spaces, and their counts."""
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        c = Counter(data[a:b].tobytes().lower().split())
        out.append((b" ".join(c), np.fromiter(c.values(), np.int32, len(c)).tobytes()))
    return out


def fit(bags_: list[tuple[bytes, bytes]], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    """A model from labelled texts as word_counts gives them. With one class only, all scores are that class's share."""
    toxic = np.asarray(toxic, bool)
    table = np.zeros(1 << 21, np.float32)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.05
        curve = np.zeros(POOL + 1)
        curve[-1] = np.log(share / (1 - share))
        return Model(table, -1.0, curve)
    # words as numbers: a text is an array of its distinct ones
    number: dict[bytes, int] = {}
    bags = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int32) for t, _ in bags_]
    words_ = list(number)
    in_pos, in_neg = (np.bincount(np.concatenate([b for b, y in zip(bags, toxic, strict=True) if y == side]), minlength=len(words_)) for side in (True, False))
    n_pos, n_neg = toxic.sum(), (~toxic).sum()
    long_ = np.array([len(w) for w in words_]) > 3
    ratio = np.where(long_ & (in_pos > 0), np.log((in_pos + 0.3) / (n_pos + 0.6)) - np.log((in_neg + 0.3) / (n_neg + 0.6)), -9.0)
    strength = np.where((in_pos >= 3) & (ratio > 2), ratio * np.log1p(in_pos), 0)
    strong = [words_[i] for i in np.argsort(-strength, kind="stable")[: int((strength > 0).sum())]]
    usual = np.array([len(w) for w in words_]) > 2
    frequent = np.argsort(-np.where(usual, in_neg, 0), kind="stable")[:4000]
    plain = [words_[i] for i in frequent if in_neg[i]]
    marks = strong[: landmarks * 2 // 3]
    marks += [w for w in plain if ratio[number[w]] < 0.5][: landmarks - len(marks)]
    triples = {t for w in marks for t in _triples(w)}
    columns = {t: j for j, t in enumerate(sorted(triples))}
    phi = _features(marks, columns)
    k = (phi @ phi.T).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T
    drawn = np.array([zlib.crc32(w) for w in words_], np.int64)
    drawn[(in_neg == 0) | (in_neg >= 50) | ~usual] = 1 << 40
    rare = [words_[i] for i in np.argsort(drawn, kind="stable")[:5000] if drawn[i] < 1 << 40]
    taken = set(strong)
    minus = [w for w in dict.fromkeys(plain + rare) if w not in taken]
    marks_root = (phi.T @ root).astype(np.float32)
    known: dict[bytes, np.ndarray] = {}
    alpha, bias = np.zeros(len(marks)), -1.0
    extra: list[bytes] = []
    spread = np.r_[0, np.cumsum([len(w) + 1 for w in words_])]
    joined = np.frombuffer(b" ".join([*words_, b""]), np.uint8)
    decide = lambda: np.concatenate([decisions(Words(joined[spread[lo] : spread[hi]], spread[[lo, hi]] - spread[lo]), table, bias) for lo, hi in slices(spread, 1 << 18)])
    for _ in range(3):
        plus = strong + extra
        words = plus + minus
        y = np.r_[np.ones(len(plus)), -np.ones(len(minus))]
        weight = np.log1p(np.r_[in_pos[[number[w] for w in plus]], in_neg[[number[w] for w in minus]]])
        weight[: len(plus)] *= 0.7 * weight[len(plus) :].sum() / max(weight[: len(plus)].sum(), 1e-9)
        new = [w for w in words if w not in known]
        for lo in range(0, len(new), 500):  # few at a time: there are thousands of triples
            known.update(zip(part := new[lo : lo + 500], _features(part, columns) @ marks_root, strict=True))
        z = np.array([known[w] for w in words])
        u, bias = _svm(z, y, weight)
        alpha = root @ u
        table[:] = 0
        table[list(columns)] = (alpha @ phi).astype(np.float32)
        # toxic texts without a word above the margin name their best word; clean texts name words wrongly above it
        f_all = f = decide()
        best = np.array([b[np.argmax(np.where(long_[b], f[b], -9))] if len(b) else -1 for b in bags])
        near = (best >= 0) & toxic & (f[best] > -0.5) & (f[best] < 0.3) & (ratio[best] > 1)
        extra = sorted({words_[i] for i in best[near]} - taken)
        wrong = np.flatnonzero((in_neg > 0) & (f > -0.3) & (ratio < 1))
        minus = list(dict.fromkeys(minus + [w for i in wrong[np.argsort(-f[wrong])][:3000] if (w := words_[i]) not in taken]))
    # a pool needs each word's decision and count, not the text's order
    pools = np.zeros((len(bags), POOL))
    for i, (bag, (_, n)) in enumerate(zip(bags, bags_, strict=True)):
        pools[i] = _pool_of(f_all[bag], np.frombuffer(n, np.int32))
    return Model(table, bias, _logistic(pools, toxic.astype(float)), marks, u)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, y, text): up to limit rows that have a label and an allowed id, those of the smallest hashes of id
    and text; limit bounds them however often an id repeats."""
    rows = tagged(docs, id_col, text_col)
    y = F.col(label).cast("int")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where(F.col("y").isin(0, 1) & allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = rows.select("doc_id", "tag").join(good, "doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), "doc_id", "tag").limit(limit)
    return rows.join(F.broadcast(some), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])  # limit rows


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id (with carry: the whole row as the struct `row`), held_out (crc32 of the id mod 3 is
    1), score, predicted."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = word_counts(*text_buffers(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.binary())], ["doc_id", "tag", "y", "words", "counts"])

    sample = labelled_sample(docs, labels, label, F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(False)), fit_rows, id_col, text_col)
    rows = sample.select("doc_id", "tag", "y", "text").mapInArrow(bags, "doc_id long, tag long, y int, words binary, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("tag", "ascending")])
    model = fit(list(zip(rows.column("words").to_pylist(), rows.column("counts").to_pylist(), strict=True)), np.array(rows.column("y").to_pylist(), bool))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = tagged(docs, id_col, text_col, whole=carry)
    payload = "row" if carry else "text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, off = text_buffers(batch.column(1).field(text_col) if carry else batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in slices(off):
                out[lo:hi] = model.score(data, off[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1 : 1 + carry], pa.array(out)], ["doc_id", *["row"] * carry, "score"])

    kind = f"row {given.schema['row'].dataType.simpleString()}, " if carry else ""
    key = real_id(F.col("doc_id"))
    out = given.select("doc_id", payload).mapInArrow(score, f"doc_id long, {kind}score double")
    return out.select("row" if carry else key.alias("doc_id"), F.coalesce(crc_mod(key, 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
