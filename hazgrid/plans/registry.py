"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazgrid.plans import drives, feeds, habits, hazards, joins, lines, live, paths, risk, routes, shapes, text, trips

MODULES = (risk, hazards, joins, paths, trips, drives, routes, lines, shapes, live, feeds, habits, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risk_realized_by_user(spark, sf_dir)
