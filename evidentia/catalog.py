"""All queries built on the generic operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.queries import details, graphs, imports, indexes, predicates, relational, retrieval, rules, streams  # noqa: F401  they register their queries
from evidentia.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["x4_fused_retrieval"](spark, sf_dir)
