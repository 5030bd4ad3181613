"""All queries of the engine over the standard tables, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query defined twice: {key}")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["eval_breakdowns"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import curation, evaluation, files, gathering, modelling, relational, shelled, texts, values  # noqa: F401  each registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
