"""Session settings the jobs rely on, applied to a running session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A scan is lambdas inside lambdas; each level takes the analyzer a pass, and masks go beyond the 100 it allows.
    "spark.sql.analyzer.maxIterations": "250",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot sessions are split at run time, also where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keyed session state outgrows the heap; it lives in RocksDB and is checkpointed.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; memory and shuffle width stay the cluster's own."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for durable checkpoints: the one the cluster names, else a local one for tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="warden-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one parquet table of a folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the checkpoint folder and read it back, so that several readers compute it once."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
