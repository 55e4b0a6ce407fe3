"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """Tables and adapters of one data directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.SQL:
            return adapters.frame(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a function of a Source under ``name``; ``uses`` names the adapters that the SQL reads."""

    def add(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Source(spark, sf_dir))
        if sql:
            head = adapters.with_sql(*uses.split()) if uses else ""
            body = sql.strip()
            if head and body.upper().startswith("WITH RECURSIVE "):
                body = head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + body[len("WITH RECURSIVE ") :]
            elif head and body.upper().startswith("WITH "):
                body = head.rstrip() + ", " + body[5:]
            else:
                body = head + body
            ORACLE_SQL[name] = body
        return build

    return add
