"""Queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuloom.plans import analytics, checks, construction, evidence, records, release, rules, selection, subsets, views  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline calibration metrics by model and condition."""
    return analytics.headline_metrics(spark, sf_dir)


def queries() -> dict:
    return dict(views.QUERIES) | analytics.NO_SQL | construction.NO_SQL | subsets.NO_SQL | evidence.NO_SQL


def oracle_sql() -> dict:
    return dict(views.SQL)
