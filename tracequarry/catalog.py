"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import audits, contents, evaluation, hygiene, knowledge, parsing, traces  # noqa: F401  they register their queries
from .plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_etl(spark, sf_dir)
