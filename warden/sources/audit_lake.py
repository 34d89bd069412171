"""The metadata-only audit lake: what may be written, and reading logs of all schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from warden.functions import sql as S
from warden.functions.sql import Sql
from warden.vocab import KNOWN

AUDIT_SCHEMA = """
schema int, timestamp_unix_ms bigint, guard_version string, agent string, agent_version string, adapter_schema int,
event string, session string, call string, capability string, decision string, rule_id string, category string,
severity string, policy_layer string, mode string, enforcement_decision string, enforcement_rule_id string,
sensitivity_categories array<string>, sink string, result_status string, result_content_type string,
result_byte_size bigint, source_ids array<string>, exit_code int"""


def pseudonymize(value: Column) -> Column:
    """a stable pseudonym; NULL stays NULL."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def known(value: Sql, kind: str) -> Sql:
    """a value of a closed list, anything else as unknown."""
    return S.when(value.isNull(), S.lit(None).cast("string")).when(value.isin(*KNOWN[kind]), value).otherwise("unknown")


def pre_records(decisions: DataFrame, audit_only: bool = False) -> DataFrame:
    """Audit rows of decided calls: no path, command, reason or raw identifier survives the projection."""
    own = decisions.columns
    text = lambda name: F.col(name) if name in own else F.lit(None).cast("string")
    return decisions.select(
        F.lit(4).alias("schema"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_unix_ms"),
        S.col(known(S.ref("agent"), "agent")).alias("agent"), F.lit("pre_tool_use").alias("event"),
        pseudonymize(F.col("session_id")).alias("session"), pseudonymize(F.col("call_id").cast("string")).alias("call"),
        "capability", F.col("effect").alias("decision"), "rule_id", "category", "severity", "policy_layer",
        F.lit("audit_only" if audit_only else "enforce").alias("mode"),
        F.coalesce(text("enforced_effect"), "effect").alias("enforcement_decision"),
        F.coalesce(text("enforced_rule_id"), "rule_id").alias("enforcement_rule_id"),
        (F.col("prior") if "prior" in own else F.expr("cast(null as array<string>)")).alias("sensitivity_categories"),
        text("sink").alias("sink"), F.to_date("ts").alias("date"))


def post_records(results: DataFrame) -> DataFrame:
    """Audit rows of observed results; sources are ids only."""
    return results.select(
        F.lit(4).alias("schema"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_unix_ms"),
        S.col(known(S.ref("agent"), "agent")).alias("agent"), F.lit("post_tool_use").alias("event"),
        pseudonymize(F.col("session_id")).alias("session"), pseudonymize(F.col("call_id").cast("string")).alias("call"),
        "capability", F.lit("recorded").alias("decision"), F.col("result.status").alias("result_status"),
        S.col(known(S.expr("result.content_type"), "content_type")).alias("result_content_type"),
        F.col("result.byte_size").alias("result_byte_size"), "source_ids", "sensitivity_categories",
        F.to_date("ts").alias("date"))


def result_records(results: DataFrame) -> DataFrame:
    """Audit rows of contained results: the verdict, the exit code and source ids; there is no column for a body."""
    return results.select(
        F.lit(4).alias("schema"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_unix_ms"),
        S.col(known(S.ref("agent"), "agent")).alias("agent"), F.lit("result_containment").alias("event"),
        pseudonymize(F.col("session_id")).alias("session"), "decision", F.col("exit_code").cast("int").alias("exit_code"),
        "source_ids", "sensitivity_categories", F.to_date("ts").alias("date"))


def all_records(*kinds: DataFrame) -> DataFrame:
    """Records of several kinds as rows of one log; columns that a kind does not have are null and not written."""
    first, *rest = kinds
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def write_audit(records: DataFrame, path: str, fmt: str = "json", checkpoint: str | None = None):
    """S10, ST5: append records by event and day; a streaming frame needs a checkpoint folder."""
    if records.isStreaming:
        return (records.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
                .partitionBy("event", "date").outputMode("append"))
    records.write.mode("append").partitionBy("event", "date").format(fmt).save(path)
    return None


def commit_batch(outputs: dict[str, DataFrame], path: str, query: str, batch_id: int) -> None:
    """ST5: the outputs of one micro-batch, each row once however often the batch is delivered.

    Every output has a folder per (query, batch), which a repeated delivery replaces. The batch counts once its row is in
    the ledger, which is written last: what a lost driver left half written is not read and is replaced later.
    """
    spot = f"query={query}/batch={batch_id}"
    for name, records in outputs.items():
        records.write.mode("overwrite").parquet(f"{path}/{name}/{spot}")
    spark = next(iter(outputs.values())).sparkSession
    spark.range(1).select(F.array(*[F.lit(n) for n in sorted(outputs)]).alias("outputs")).write.mode(
        "overwrite").parquet(f"{path}/ledger/{spot}")


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one output, of the batches that the ledger holds."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    done = spark.read.option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").where(
        F.array_contains("outputs", name)).select("query", "batch")
    return rows.join(done, ["query", "batch"], "left_semi").drop("query", "batch")


def complete(records: DataFrame) -> DataFrame:
    """Rows of schema 1 had no mode and no enforcement fields; they were always enforced as decided."""
    old = F.col("schema") < 2
    pre = F.col("event") == "pre_tool_use"
    fill = lambda name, value: F.when(pre & (old | F.col(name).isNull()), value).otherwise(F.col(name))
    return (
        records.withColumn("mode", fill("mode", F.lit("enforce")))
        .withColumn("enforcement_decision", fill("enforcement_decision", F.col("decision")))
        .withColumn("enforcement_rule_id", fill("enforcement_rule_id", F.col("rule_id"))))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A log of mixed schema versions; event and date prune partitions."""
    return complete(spark.read.schema(AUDIT_SCHEMA + ", date date").json(path))


def by_event(records: DataFrame) -> dict[str, DataFrame]:
    """The three kinds of record, each with its own columns."""
    pre = ["capability", "decision", "rule_id", "severity", "mode", "enforcement_decision", "enforcement_rule_id", "sink"]
    post = ["capability", "result_status", "result_content_type", "result_byte_size", "source_ids"]
    base = ["schema", "timestamp_unix_ms", "agent", "session"]
    return {
        "pre": records.where("event = 'pre_tool_use'").select(*base, "call", *pre),
        "post": records.where("event = 'post_tool_use'").select(*base, "call", *post),
        "result": records.where("event = 'result_containment'").select(*base, "decision", "exit_code", "source_ids"),
    }
