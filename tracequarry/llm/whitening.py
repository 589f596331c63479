"""Whitening of embeddings by exact integer covariances from bit planes.

Entries become integers (floor of scale times the entry, in the query plus an offset that cancels out). A task takes its
rows in blocks; in each block a dimension's integers are shifted to begin at zero, and bit b of all of them is packed
into 64-bit words. The cross-product of two dimensions is then the sum over pairs of their planes of 2^(a + b) times the
population count of the planes' AND; shifts are taken back by the dimensions' sums. Sums over tasks are exact decimals;
the covariance is centred as n * sum(x y) - sum(x) sum(y) in integers and turned into doubles only for its eigenvectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import settle

ROWS = 1 << 14  # rows of a block
LARGEST = 2.0**46  # of an integer


def integers(vector: Column, scale: float = 64) -> Column:
    """Entries as floor(scale * entry); null for a null or empty vector and for one with null or non-finite entries, or
    entries of 2^46 or more after scaling, which can't be multiplied exactly."""
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    good = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when((F.size(scaled) > 0) & good, F.transform(scaled, lambda c: F.floor(c)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Arrays of d integers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of non-negative u as rows of 64-bit words: (words, column, bit)."""
    n, d = u.shape
    bits = [int(m).bit_length() for m in u.max(axis=0)]
    column = np.repeat(np.arange(d), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if sum(bits) else np.zeros(0, np.int64)
    packed = np.zeros((len(bit), -(-n // 64) * 8), np.uint8)
    for b in range(max(bits, default=0)):
        mine = np.flatnonzero(bit == b)
        rows = np.packbits((u[:, column[mine]] >> b & 1).astype(np.uint8).T, axis=1)
        packed[mine, : rows.shape[1]] = rows
    return packed.view(np.uint64), column, bit


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums of columns, sums of products of columns) of an integer matrix, as Python integers."""
    n, d = y.shape
    low = y.min(axis=0)
    words, column, bit = bit_planes(y - low)
    count = np.zeros((len(bit), len(bit)), np.int64)
    for p in range(len(bit)):
        count[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    count = np.maximum(count, count.T)
    weight = np.zeros((d, len(bit)), object if 2 * bit.max(initial=0) + 2 + n.bit_length() > 62 else np.int64)
    weight[column, np.arange(len(bit))] = [1 << int(b) for b in bit]
    total = (weight @ count.diagonal() if len(bit) else np.zeros(d, np.int64)).astype(object)
    cross = (weight @ count @ weight.T).astype(object) if len(bit) else np.zeros((d, d), object)
    low = low.astype(object)
    return total + n * low, cross + np.outer(low, total) + np.outer(total, low) + n * np.outer(low, low)


def _scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) of column x. Each task gives one row for each pair of dimensions, and as many
    reach the driver."""
    i, j = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        held: list[np.ndarray] = []

        def add():
            nonlocal n, total, cross
            y = np.concatenate(held)
            held.clear()
            for a in range(0, len(y), ROWS):
                s, c = cross_products(y[a : a + ROWS])
                n, total, cross = n + len(y[a : a + ROWS]), total + s, cross + c

        for batch in batches:
            held.append(matrix(batch.column(0), d))
            if sum(map(len, held)) >= ROWS:
                add()
        if held:
            add()
        if n:
            values = [n, *total, *cross[i, j]]
            left, right = [-1, *[-1] * d, *i.tolist()], [-1, *range(d), *j.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])

    found = fit.select("x").mapInArrow(partial, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in found:
        v = int(r["v"])
        if r["j"] < 0:
            n = v
        elif r["i"] < 0:
            total[r["j"]] = v
        else:
            cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = v
    return n, total, cross


@dataclass
class Whitening:
    """n and sums of the fit list, and for each kept component its unit vector (columns), variance and share."""

    n: int
    total: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n times the deviations from the mean, exact."""
        small = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.total), default=0) < 1 << 62
        return y * self.n - np.array(self.total, np.int64) if small else y.astype(object) * self.n - np.array(self.total, object)

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates, row by component."""
        return (centred.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.variances))


def fitted(n: int, total: np.ndarray, cross: np.ndarray, most: int) -> Whitening:
    """Principal components by falling variance, up to most. Those without variance (below the precision of the largest)
    can't be scaled to one and are left out. The largest entry of a vector is positive."""
    exact = n * cross - np.outer(total, total)
    v = np.array([[x / (n * n) for x in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0) * len(v) * np.finfo(float).eps][:most]
    vectors = vectors[:, order]
    if len(order):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    trace = sum(exact.diagonal()) / (n * n) if n else 0.0
    return Whitening(n, [int(x) for x in total], vectors, values[order], values[order] / trace if trace else values[order])


def _identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured on the list itself."""
    k = len(model.variances)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = model.projected(model.centred(matrix(batch.column(0), d)))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

    sums = np.zeros(k + k * k)
    for r in fit.select("x").mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    mean = sums[:k] / model.n
    return float(np.abs(sums[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, most: int = 16, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with a vector and each component up to most: vec_id, component (from 1), n (rows of the fit list),
    deviation (sum over dimensions of (n x - sum)^2, exact; null from 10^38 on), whitened, explained (share of the
    variance), identity_error (one value).

    The fit list has each distinct integer vector once, whatever its ids, so copies don't weigh more. Left out are rows
    that integers() gives null for, and vectors of another length than most rows have (the greater of equally frequent
    lengths). Repeated and null ids keep all their rows. Components without variance have no rows; an empty table, or one
    whose vectors are all equal, gives an empty result. Other columns may have any names."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], SCHEMA)
    d = usual["d"]
    rows = rows.where(F.size("x") == d)
    fit = settle(rows.select("x").distinct())
    model = fitted(*_scatter(fit, d), most)
    k = len(model.variances)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    error = _identity_error(fit, d, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = model.centred(matrix(batch.column(1), d))
            m = len(c)
            largest = int(np.abs(c).max(initial=0))
            square = c if largest * largest * d < 1 << 63 else c.astype(object)
            deviation = [decimal.Decimal(int(v)) if v < 10**38 else None for v in (square * square).sum(axis=1)]
            where = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(where)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(where)),
                pa.array(model.projected(c).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
            ], [x.split()[0] for x in SCHEMA.replace("38,0", "38").split(", ")])

    return rows.mapInArrow(project, SCHEMA)
