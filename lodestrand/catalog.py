"""The queries of the analytics operators, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.build for q in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in REGISTRY if q.sql}
