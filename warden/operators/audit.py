"""Audit lake reports and review metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.operators.running import running_sum


def summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts with all sub-totals. The finest counts are made first; only they are multiplied by the cube."""
    by = by or ["agent", "capability", "rule_id", "decision", "severity", "day"]
    finest = records.groupBy(*by).agg(F.count("*").alias("n"))
    return finest.cube(*by).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def false_positive_rate(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed erroneous denials of each rule over its reviewed denials, with both counts.

    Reviews are counted per rule before anything is divided, so a rule that holds
    most denials is reduced map-side.
    """
    reviewed = records.where("decision = 'deny'").join(reviews, "call_id")
    return reviewed.groupBy("rule_id").agg(
        F.count("*").alias("n_reviewed"), F.count_if("erroneous").alias("n_erroneous")
    ).withColumn("rate", F.col("n_erroneous") / F.col("n_reviewed"))


def latency(samples: DataFrame, bucket: int = 1_000) -> DataFrame:
    """Nearest-rank p50, p95 and p99, min, max and count per workload.

    Equal samples are counted first and ranked by a bucketed running sum, so the
    samples of one hot workload are never held or sorted in one task.
    """
    counts = samples.groupBy("workload", "ns").agg(F.count("*").alias("n"))
    ranked = running_sum(counts, ["workload"], ["ns"], "n", F.floor(F.col("ns") / F.lit(bucket)), "upto")
    totals = counts.groupBy("workload").agg(
        F.sum("n").alias("samples"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns"))
    joined = ranked.join(totals, "workload")

    def nearest(percent: int):
        place = F.floor((F.col("samples") * percent + 99) / F.lit(100))
        return F.min(F.when(F.col("upto") >= place, F.col("ns"))).alias(f"p{percent}_ns")

    return joined.groupBy("workload", "samples", "min_ns", "max_ns").agg(nearest(50), nearest(95), nearest(99))


def regressions(current: DataFrame, baseline: DataFrame, allowed: float = 0.2) -> DataFrame:
    """Workloads whose p50 or p95 grew by more than the allowed share."""
    base = baseline.select("workload", F.col("p50_ns").alias("base_p50"), F.col("p95_ns").alias("base_p95"))
    return current.join(base, "workload").where(
        (F.col("p50_ns") > F.col("base_p50") * (1 + allowed)) | (F.col("p95_ns") > F.col("base_p95") * (1 + allowed)))


def coverage(calls: DataFrame, matrix: DataFrame) -> DataFrame:
    """Calls per (agent, capability) with what the matrix says of the route; the matrix has 16 rows."""
    used = calls.groupBy("agent", "capability").agg(F.count("*").alias("n_calls"))
    return used.join(F.broadcast(matrix.withColumnRenamed("tool_category", "capability")), ["agent", "capability"], "left")


def explained(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions with their remediation; the catalog is a fixed table."""
    return decisions.join(F.broadcast(catalog.select("rule_id", "remediation")), "rule_id", "left")


def undocumented(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules that decided something and are not in the catalog."""
    used = decisions.groupBy("rule_id").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(catalog.select("rule_id")), "rule_id", "left_anti")
