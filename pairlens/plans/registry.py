"""All registered queries with their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("columns", "score", "aggregate", "hypotheses", "joins", "spatial", "sources", "sample", "fit")


def _all():
    return [import_module(f"pairlens.plans.q_{m}").Q for m in MODULES]


def queries() -> dict:
    return {name: f for q in _all() for name, f in q.items()}


def oracle_sql() -> dict:
    return {name: sql for q in _all() for name, sql in q.sql.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a02_rubric"](spark, sf_dir)
