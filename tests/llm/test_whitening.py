"""Whitening against exact fractions: cross-products, deviations, components, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tracequarry.llm import whitening
from tracequarry.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


@pytest.mark.parametrize(("n", "d", "most"), [(1, 3, 5), (63, 4, 1), (64, 1, 1000), (200, 9, 2**30), (70, 3, 2**45)])
def test_cross_products(n, d, most):
    y = np.random.default_rng(n).integers(-most, most + 1, (n, d))
    y[:, 0] = 7
    total, cross = whitening.cross_products(y)
    big = y.astype(object)
    assert total.tolist() == big.sum(axis=0).tolist() and cross.tolist() == (big.T @ big).tolist()


def expected(rows, most=16):
    """By id, whatever is left of it: deviations, whitened values; and shares. Plain doubles after exact centring."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]))[0]
    kept = [(i, [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v]) for i, v in good if len(v) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, s = len(fit), fit.sum(axis=0)
    dev = fit * n - s
    v = (dev.T @ dev / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    k = np.argsort(-e)[:most]
    return n, [(i, int(((np.array(x, object) * n - s) ** 2).sum()), ((np.array(x, object) * n - s) / n).astype(float) @ u[:, k] / np.sqrt(e[k])) for i, x in kept], e[k] / e.sum()


def compare(got, rows, most=16):
    n, want, share = expected(rows, most)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == len(want) * len(share)
    sign = None
    for i, dev, w in want:
        mine = by[i, dev]
        each = {r.component: r for r in mine}
        x = np.array([each[c + 1].whitened for c in range(len(share))])
        if sign is None and (np.abs(w) > 1e-6).all():
            sign = np.sign(w * x)
        if sign is not None:
            assert np.abs(x - sign * w).max() < 1e-6
        assert all(r.n == n and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9 for r in mine)
    assert sign is not None


def test_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(200)] + [(7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan")] * 5), (904, [float("inf")] + [0.0] * 4), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA).repartition(4)
    compare(whitening.whitened(df).collect(), rows)
    compare(whitening.whitened(df, most=2).collect(), rows, 2)


def test_without_variance(spark):
    rows = [(i, [1.0, float(i % 3), 2.0]) for i in range(9)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA)
    got = whitening.whitened(df).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].n == 3 and got[0].explained == pytest.approx(1)
    assert whitening.whitened(df.where("vec_id = 0")).collect() == []
    assert whitening.whitened(df.where("vec_id < 0")).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 1.0], 1, "c"), (2, [1e8, 1.0], 1, "c"), (3, [-1e8, 5.0], 1, "c")], "vec_id long, embedding array<double>, n int, component string")
    got = whitening.whitened(huge).collect()
    assert {r.vec_id for r in got} == {2, 3} and {int(r.deviation) for r in got} == {(128 * 10**8) ** 2 + 256**2}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, sf).collect(), rows)
