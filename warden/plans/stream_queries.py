"""Registered streaming queries: the given tables replayed as streams to their end (ST1-ST7).

A table comes slice by slice, and the stream starts anew from its checkpoint after each. What must come out in the end
can be said in SQL over the whole table, so the statements hold streams against batch results.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden import session
from warden.functions.fields import ScanConfig
from warden.operators import scan
from warden.plans import frame_queries, taint_queries
from warden.plans.derived import CALLS
from warden.plans.registry import query
from warden.sources import audit_lake
from warden.streaming import frames as live_frames, scan as live_scan, taint as live_taint
from warden.vocab import CATEGORIES

CONFIG = ScanConfig(ip_personal=True)


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream."""
    schema = session.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything a stream emits until its input ends, as a table in the checkpoint folder."""
    spark = stream.sparkSession
    base = os.path.join(session.checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    out, state = os.path.join(base, "out"), os.path.join(base, "state")
    job = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
           .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def in_slices(df: DataFrame, slices: list, live, last: DataFrame | None = None) -> DataFrame:
    """What ``live`` makes of a table that comes slice by slice (conditions); ``last`` is a slice after all others.

    After each slice the stream ends and starts anew from its checkpoint, as after a lost driver.
    """
    spark = df.sparkSession
    base = os.path.join(session.checkpoint_dir(spark), f"slices-{uuid.uuid4().hex}")
    path, out, state = (os.path.join(base, name) for name in ("in", "out", "state"))
    for part in [df.where(c) for c in slices] + ([] if last is None else [last]):
        part.write.mode("append").parquet(path)
        stream = live(spark.readStream.schema(df.schema).parquet(path))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


def by_time(*moments: str) -> list:
    """Conditions on ts for the slices between moments."""
    edges = [F.lit(m).cast("timestamp") for m in moments]
    ts = F.col("ts").cast("timestamp")
    return [ts < edges[0], *[(ts >= a) & (ts < b) for a, b in zip(edges[:-1], edges[1:])], ts >= edges[-1]]


def call_events(events: DataFrame) -> DataFrame:
    """Decided calls of a stream (or table) of events, with what they show and where they send."""
    done = taint_queries.decided(taint_queries.with_taint(events.sparkSession.sql(CALLS, events=events)))
    return done.select(
        "agent", "session_id", F.col("call_id").cast("string").alias("call_id"), F.lit("pre").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("seq") * 2).alias("seq"), "source_categories",
        F.col("normal_path").alias("source"), "sink", "effect", "rule_id", "capability", "category", "severity", "policy_layer")


#: A result for every call; each seventh holds an address.
RESULT = "case when k % 7 = 0 then 'mail to user' || cast(user_id as string) || '@example.test' else 'ok' end"


def result_events(events: DataFrame) -> DataFrame:
    """Results of the calls, scanned; those that held something are events after their call."""
    results = events.sparkSession.sql(CALLS, events=events).select(
        "agent", "session_id", F.col("call_id").cast("string").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("seq") * 2 + 1).alias("seq"), F.expr(RESULT).alias("text"))
    return live_scan.taint_events(results, "text", CONFIG)


def enforced_rows(out: DataFrame) -> DataFrame:
    return out.where("kind = 'pre'").select(
        F.col("call_id").cast("bigint").alias("call_id"), F.array_join("prior", ",").alias("prior"), "enforced_effect",
        "enforced_rule_id")


_SHOWN = "with {flags} select call_id, prior, enforced_effect, enforced_rule_id from e where touches or sink is not null"


@query("st1_stream_taint", _SHOWN.format(flags=taint_queries.FLAGS))
def st1(spark, folder):
    """Calls in three slices of time."""
    events = session.table(spark, folder, "events")
    return enforced_rows(in_slices(events, by_time("2024-01-03", "2024-01-15"), lambda s: live_taint.stream(call_events(s))))


#: Results are rows of their own after their call, and only the calls are shown.
WITH_RESULTS = taint_queries.FLAGS.replace("from flags),", """from (select *, 0 as after from flags union all
  select * replace (['personal_data'] as own, 'personal_data' as cats, null as sink), 1 as after from flags where k % 7 = 0)),""").replace(
    "order by ts, seq rows", "order by ts, seq, after rows")


@query("st2_stream_results", _SHOWN.format(flags=WITH_RESULTS).replace("where touches", "where after = 0 and (touches") + ")")
def st2(spark, folder):
    """Results join in as events: what a result held taints its session from then on."""
    def live(stream):
        return live_taint.stream(call_events(stream).unionByName(result_events(stream), allowMissingColumns=True))

    events = session.table(spark, folder, "events")
    return enforced_rows(in_slices(events, by_time("2024-01-03", "2024-01-15"), live))


#: Even events come first, odd ones late: what the even ones showed is known to all odd ones of their session.
LATE = taint_queries.FLAGS.replace("partition by agent, session_id order", "partition by agent, session_id, call_id % 2 order")
for _c in CATEGORIES:
    LATE = LATE.replace(f" as had_{_c}", f""" or (call_id % 2 = 1 and coalesce(bool_or(call_id % 2 = 0 and
      list_contains(own, '{_c}')) over (partition by agent, session_id), false)) as had_{_c}""")


@query("st7_late_calls", _SHOWN.format(flags=LATE))
def st7(spark, folder):
    """Late calls meet the taint that their session has when they arrive."""
    events = session.table(spark, folder, "events")
    return enforced_rows(in_slices(
        events, [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1], lambda s: live_taint.stream(call_events(s))))


def audited_twice(path: str):
    """A writer of micro-batches that delivers each twice. The stateful part of a batch runs once: its records are kept
    until all outputs are written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        records = audit_lake.pre_records(batch.where("kind = 'pre'")).persist()
        try:
            outputs = {"calls": records, "rules": records.groupBy("rule_id").count()}
            audit_lake.commit_batch(outputs, path, "calls", batch_id)
            audit_lake.commit_batch(outputs, path, "calls", batch_id)
        finally:
            records.unpersist()

    return write


@query("st5_audit_sink", f"""
with {taint_queries.FLAGS} select 'sha256:' || sha256(cast(call_id as varchar)) as call, 'sha256:' || sha256(session_id) as session,
  agent, capability, 4 as schema, 'pre_tool_use' as event, 'enforce' as mode, effect as decision, rule_id, sink,
  enforced_effect as enforcement_decision, enforced_rule_id as enforcement_rule_id, prior,
  epoch_us(cast(ts as timestamp)) // 1000 as timestamp_unix_ms, strftime(cast(ts as timestamp), '%Y-%m-%d') as day
from e where touches or sink is not null""")
def st5(spark, folder):
    """Audit rows of live calls, every batch delivered twice; rows and a count per rule are outputs of one commit."""
    path = os.path.join(session.checkpoint_dir(spark), f"audit-{uuid.uuid4().hex}")
    write = audited_twice(path)
    events = session.table(spark, folder, "events")
    feed, state = os.path.join(path, "feed"), os.path.join(path, "state")
    for part in by_time("2024-01-03", "2024-01-15"):
        events.where(part).write.mode("append").parquet(feed)
        stream = live_taint.stream(call_events(spark.readStream.schema(events.schema).parquet(feed)))
        (stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    return audit_lake.read_committed(spark, path, "calls").select(
        "call", "session", "agent", "capability", "schema", "event", "mode", "decision", "rule_id", "sink",
        "enforcement_decision", "enforcement_rule_id", F.array_join("sensitivity_categories", ",").alias("prior"),
        "timestamp_unix_ms", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("st6_written_once", "select 'sha256:' || sha256(cast(event_id as varchar)) as call from events")
def st6(spark, folder):
    """Every call is delivered twice and kept once."""
    events = session.table(spark, folder, "events")

    def live(stream):
        done = stream.select(F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)).alias("call"),
                             F.col("ts").cast("timestamp").alias("ts"))
        return live_taint.once(done, "3650 days")

    return in_slices(events, [F.lit(True), F.lit(True)], live).select("call")


@query("st3_stream_findings")
def st3(spark, folder):
    texts = source(spark, folder, "documents").select("doc_id", "text")
    return drained(scan.findings(texts, "text", "doc_id", CONFIG))


ALL_STATUSES = f"""with {frame_queries.STATUS}
select session_id, id, seq, kind, case when status = 'unanswered' then 'unanswered' else status end as status,
  case when kind <> 'request' and status in ('answered', 'cancelled') then request_seq end as request_seq,
  case when kind = 'reply' and status = 'answered' then date_diff('microsecond', request_ts, cast(ts as timestamp)) end as latency_us
from s"""


@query("st4_stream_pairs", ALL_STATUSES)
def st4(spark, folder):
    """Frames in three slices of time; a frame long after them lets the watermark pass the last requests."""
    log = frame_queries.rows(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(
        F.lit("end").alias("session_id"), F.lit("end").alias("id"), F.lit("2100-01-01").cast("timestamp").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"), F.lit("other").alias("kind"))
    live = in_slices(log, by_time("1994-06-01", "1996-09-01"),
                     lambda stream: live_frames.paired(stream, frame_queries.TIMEOUT), end)
    return live.where("kind <> 'other'").select("session_id", "id", "seq", "kind", "status", "request_seq", "latency_us")
