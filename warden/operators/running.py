"""Running sums that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def running_sum(df: DataFrame, keys: list[str], order: list[str], delta: str, bucket: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``delta`` per key; ``bucket`` must not decrease along ``order``.

    Rows are summed per bucket first (combined map-side). Only those sums pass through
    a window over the whole key; the rows themselves are sorted bucket by bucket, so
    one hot key spreads over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(delta).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.sum(delta).over(inside))
        .drop("_bucket", "_start"))
