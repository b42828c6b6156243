"""All named queries of the sports-analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.catalog import features, forecasts, teams

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form as of each fixture: unpivot, segments, rolling mean, strict lookup with a staleness bound."""
    return features.form_as_of(spark, sf_dir)


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**features.QUERIES, **teams.QUERIES, **forecasts.QUERIES}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
