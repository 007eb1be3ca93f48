"""The corpus pipeline by its contract: STAGES, ORACLE_SQL and run() of quire.llm.pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.pipeline import ORACLE_SQL, STAGES
from quire.llm.pipeline import run as _run
from quire.plans.session import ship

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    return _run(ship(spark), sf_dir)
