"""Registered queries: name, Spark plan and, where SQL can say the same, an independent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warden import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a plan over the tables of one folder."""
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(session.tune(spark), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; an input of fewer partitions than cores (a single small file) is spread out first.

    On a large table the file splits outnumber the cores and nothing moves.
    """
    df = session.table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= cores and cores > 1:
        return df.repartition(cores)
    return df
