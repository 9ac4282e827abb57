"""Every catalog query and its SQL, gathered from the modules that register them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation, events, exchange, extra, feeds, intake, joins, likeness, more, reading, registry, relevance, rules, sales, search, steps, stores, text, traits, trials  # noqa: F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in registry.QUERIES.items() if sql}
