"""Texts to scan, with the limits of a complete scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden.functions import sql as S
from warden.operators.scan import limit_rule


def read_corpus(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Whole files as texts; a file that is no UTF-8 or too large keeps the rule that blocks it and no text."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("binaryFile").load(path).select(
        F.col("path").alias("doc_id"), F.is_valid_utf8(F.col("content").cast("string")).alias("_valid"),
        F.col("content").cast("string").alias("text"))
    rule = S.col(limit_rule(S.ref("text"), S.ref("_valid")))
    return files.withColumn("rule_id", rule).withColumn(
        "text", F.when(F.col("rule_id").isNull(), F.col("text"))).drop("_valid")
