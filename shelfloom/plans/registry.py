"""The register of queries: a name, a function of (spark, sf_dir), and SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_library

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_library(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = (run, sql)
        return run

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str, precision: str = "decimal(12,2)") -> Column:
    """An exact amount: sums of decimals do not depend on their order."""
    return F.col(name).cast(precision)


def half_up(x: Column, places: int = 2) -> Column:
    """Rounded as floor(x * 10^places + 0.5) / 10^places."""
    return F.floor(x * 10**places + 0.5) / 10**places
