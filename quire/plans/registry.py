"""All registered queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detect, documents, regions, scalars

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return documents.QUERIES | detect.QUERIES | regions.QUERIES | scalars.QUERIES


def oracle_sql() -> dict[str, str]:
    return documents.SQL | detect.SQL | regions.SQL | scalars.SQL
