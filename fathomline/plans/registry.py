"""Registered queries of the deduplication library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.functions.workers import workers_import_package
from fathomline.plans import oracle, queries


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    make = getattr(queries, name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_import_package(spark)
        return make(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in queries.NAMES}
ORACLE_SQL: dict[str, str] = oracle.SQL
