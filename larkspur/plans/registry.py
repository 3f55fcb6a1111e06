"""Registry of runnable queries: one entry per operator, with its SQL check when SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Lazy access to the input tables and the domain views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in domain.BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in domain.SPARK_VIEWS:
            return self.spark.sql(domain.spark_text(name, self.sf_dir))
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; ``sql`` is the DuckDB check over the same views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = domain.with_views(sql)
        return fn

    return wrap
