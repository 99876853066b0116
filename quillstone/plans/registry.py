"""Query registry: name -> (Spark query, oracle SQL, blueprint operators covered)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists blueprint ids."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table.

    A file that gives fewer splits than there are cores (small tables with one
    row group) is spread over the cores; at scale the scan's own splits are used.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE_ROWS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


# Tables whose rows carry whole texts, where one split would keep one core busy.
WIDE_ROWS = ("documents", "pages", "conversations")
