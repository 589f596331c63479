"""Vectorised functions that need no session until they are used."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column


def vectorized(returns: str) -> Callable:
    """Like pandas_udf, but made at the call, so that a module can be imported before any session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
