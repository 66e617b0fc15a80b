"""The named queries for the reference tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES``, and ``ORACLES`` where SQL can express a query.
MODULES = ("documents", "oracles")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"shinglemill.plans.{name}"), what, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["survivors"](spark, sf_dir)
