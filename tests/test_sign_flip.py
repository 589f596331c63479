"""Sign flips keep clusters in their partitions, so no number of clusters stops them."""

from itertools import product

import pytest

from tracequarry.operators import stats


def test_sign_flips(spark):
    d = [0.5, 0.3, 0.7, 0.2, 0.4, 0.1, -0.2, 0.6, 0.3, -0.1]
    p = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(d)], "id string, diff double").repartition(3)
    exact = sum(abs(sum(s * x for s, x in zip(signs, d, strict=True))) >= abs(sum(d)) - 1e-9 for signs in product((-1, 1), repeat=10)) / 1024
    assert stats.sign_flip_test(p, "id", 20_000).first().p == pytest.approx(exact, abs=0.006)
