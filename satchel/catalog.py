"""Every registered query of the library with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.plans import archive_queries, page_queries, replay_queries, table_queries  # noqa: F401  (add their queries)
from satchel.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: keyword and vector rankings of a batch of queries, fused."""
    return QUERIES["v4_hybrid"](spark, sf_dir)
