"""Live scan: the batch operators on a stream, and what they add to taint (ST3, ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.detectors import detect
from warden.functions.fields import ScanConfig
from warden.functions.spans import merge
from warden.operators.scan import findings, ordered_categories, verdicts
from warden.sources.audit_lake import write_audit

__all__ = ["findings", "taint_events", "verdicts", "write_audit"]


def taint_events(results: DataFrame, text: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """ST3: results whose text held something, as post events for the taint stream. Map-only; the text is dropped."""
    found = S.let(merge(detect(S.ref(text), config)), lambda m: S.struct(
        ordered_categories(S.transform(m, lambda s: s["category"])).alias("source_categories"),
        S.array_join(S.array_sort(S.array_distinct(S.transform(m, lambda s: s["detector"]))), ",").alias("source")))
    hit = results.withColumn("_f", S.col(found)).select(
        "agent", "session_id", "call_id", "ts", "seq", "_f.source_categories", "_f.source")
    return hit.select(
        "agent", "session_id", "call_id", F.lit("post").alias("kind"), "ts", "seq", "source_categories", "source",
        F.lit(None).cast("string").alias("sink"), F.lit("allow").alias("effect"), F.lit("recorded").alias("rule_id"))
