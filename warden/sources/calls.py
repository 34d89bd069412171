"""Tool-call and tool-result logs of three agents, as one canonical table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden.functions import sql as S
from warden.functions.calls import candidates, capability, is_mcp, patch_paths, query_not_text
from warden.functions.paths import is_absolute, normalize
from warden.functions.sql import Sql
from warden.functions.variants import nodes
from warden.vocab import MAX_IDENTIFIER_BYTES, MAX_LIST, MAX_PATH_BYTES, MAX_STRING_BYTES

# --- fixed values: envelopes as each agent writes them -----------------------
ENVELOPES = {
    "codex": "session_id string, cwd string, hook_event_name string, tool_name string, tool_use_id string, tool_input variant",
    "cursor": ("session_id string, conversation_id string, cwd string, tool_name string, tool_use_id string, "
               "tool_input variant"),
    "opencode": "schema int, session_id string, call_id string, cwd string, tool_name string, tool_input variant",
}
RESULTS = {
    "codex": ", tool_response variant", "cursor": ", tool_output string, duration int",
    "opencode": ", status string, content_type string, byte_size bigint",
}
CANONICAL = ("protocol", "agent", "event", "session_id", "call_id", "cwd", "tool_name", "capability", "input", "paths",
             "command", "urls", "error")
_NONE = "cast(array() as array<string>)"


def _field(name: str) -> Sql:
    return S.when(S.schema_of_variant(S.try_variant_get(S.ref("tool_input"), f"$.{name}", "variant")) == "STRING",
                  S.try_variant_get(S.ref("tool_input"), f"$.{name}", "string"))


def canonical(envelopes: DataFrame, agent: str, event: str = "pre_tool_use", extra: tuple[str, ...] = ()) -> DataFrame:
    """Envelope rows of one agent as canonical calls; ``error`` says why a row is not a usable call."""
    tool, cwd = S.ref("tool_name"), S.ref("cwd")
    if agent == "cursor":
        envelopes = envelopes.withColumn("session_id", F.coalesce("session_id", "conversation_id"))
    rows = envelopes.withColumn("capability", S.col(capability(S.lit(agent), tool))).withColumn("_command", S.col(_field("command")))
    kind, command = S.ref("capability"), S.ref("_command")
    patch = S.lit(False)
    if agent == "codex":
        patch, patch_text = tool == "apply_patch", command
    elif agent == "opencode":
        patch, patch_text = S.lower(tool) == "apply_patch", S.coalesce(_field("patchText"), _field("patch_text"))
    paths = candidates(S.ref("tool_input"), "path")
    if agent != "cursor":
        paths = S.when(patch, patch_paths(patch_text)).otherwise(paths)
    skip = kind.isin("shell_execute") | (kind.isin("unknown", "network_read") if agent == "codex" else S.lit(False))
    rows = rows.withColumn("paths", S.col(S.when(skip, S.expr(_NONE)).otherwise(S.coalesce(paths, S.expr(_NONE)))))
    here = cwd
    if agent == "cursor":
        given = S.try_variant_get(S.ref("tool_input"), "$.working_directory", "variant")
        here = S.when(given.isNull(), cwd).otherwise(normalize(cwd, _field("working_directory")))
    rows = rows.withColumn("_cwd", S.col(here))
    shell = kind == "shell_execute"
    needs_path = kind.isin("file_read", "file_write", "file_delete") & (S.size(S.ref("paths")) == 0)
    error = S.when(S.ref("tool_input").isNull() | tool.isNull(), "malformed envelope")
    if agent == "codex":
        wanted = "PreToolUse" if event == "pre_tool_use" else "PostToolUse"
        error = error.when(S.coalesce(S.ref("hook_event_name") != wanted, S.lit(True)), "wrong event")
    if agent == "opencode":
        error = error.when(S.coalesce(S.ref("schema") != 1, S.lit(True)), "unsupported schema")
    error = error.when(shell & command.isNull(), "no command").when(needs_path, "no path").when(
        S.ref("_cwd").isNull(), "invalid working directory")
    urls = S.expr(_NONE)
    if agent == "opencode":
        urls = S.when((kind == "network_read") & _field("url").isNotNull(), S.array(_field("url"))).otherwise(urls)
    id_ = "call_id" if agent == "opencode" else "tool_use_id"
    return rows.select(
        F.lit(1).cast("smallint").alias("protocol"), F.lit(agent).alias("agent"), F.lit(event).alias("event"), "session_id",
        F.col(id_).alias("call_id"), F.col("_cwd").alias("cwd"), "tool_name", "capability",
        F.col("tool_input").alias("input"), "paths", S.col(S.when(shell, command)).alias("command"),
        S.col(urls).alias("urls"), S.col(error).alias("error"), *extra)


def read_calls(spark: SparkSession, path: str, agent: str, streaming: bool = False) -> DataFrame:
    """One agent's pre-call envelopes, one JSON object per line."""
    reader = spark.readStream if streaming else spark.read
    return canonical(reader.schema(ENVELOPES[agent]).json(path), agent)


def with_result(envelopes: DataFrame, agent: str) -> DataFrame:
    """Results keep status, type and size; the body is measured and dropped."""
    if agent == "codex":
        facts = (F.lit("completed"), F.lit("application/json"), F.octet_length(F.to_json("tool_response")))
    elif agent == "cursor":
        facts = (F.lit("completed"), F.lit("application/json"), F.octet_length("tool_output"))
    else:
        facts = (F.col("status"), F.col("content_type"), F.col("byte_size"))
    sized = envelopes.select("*", *[f.alias(n) for f, n in zip(facts, ("r_status", "r_type", "r_size"))])
    done = canonical(sized, agent, "post_tool_use", ("r_status", "r_type", "r_size"))
    return done.withColumn("result", F.struct(
        F.col("r_status").alias("status"), F.col("r_type").alias("content_type"),
        F.col("r_size").cast("bigint").alias("byte_size"))).drop("r_status", "r_type", "r_size")


def read_results(spark: SparkSession, path: str, agent: str, streaming: bool = False) -> DataFrame:
    """One agent's post-call envelopes."""
    reader = spark.readStream if streaming else spark.read
    return with_result(reader.schema(ENVELOPES[agent] + RESULTS[agent]).json(path), agent)


def unify(*calls: DataFrame) -> DataFrame:
    """One table from the logs of several agents."""
    first, *rest = calls
    for other in rest:
        first = first.unionByName(other)
    return first


def with_candidates(calls: DataFrame) -> DataFrame:
    """P3 on canonical calls: paths, commands and queries, also from the input of tools without a mapping (O3)."""
    open_ = is_mcp(S.ref("tool_name"), S.ref("capability")) | (S.ref("capability") == "unknown")
    found = lambda kind: S.when(open_, S.coalesce(candidates(S.ref("input"), kind), S.expr(_NONE))).otherwise(S.expr(_NONE))
    own = S.when(S.ref("command").isNotNull(), S.array(S.ref("command"))).otherwise(S.expr(_NONE))
    return (
        calls.withColumn("paths", S.col(S.concat(S.ref("paths"), found("path"))))
        .withColumn("commands", S.col(S.concat(own, found("command"))))
        .withColumn("queries", S.col(found("query")))
        .withColumn("error", S.col(S.coalesce(S.ref("error"), S.when(
            open_ & query_not_text(S.ref("input")), "query is not text")))))


def _identifier(value: Sql) -> Sql:
    return (value == "") | (S.octet_length(value) > MAX_IDENTIFIER_BYTES) | S.contains(value, "\0")


def defects(calls: DataFrame) -> DataFrame:
    """Adds ``reasons``, an array that is empty for valid calls."""
    def required(name: str) -> Sql:
        return S.when(S.coalesce(_identifier(S.ref(name)), S.lit(True)), f"invalid {name}")

    def optional(name: str) -> Sql:
        return S.when(S.coalesce(_identifier(S.ref(name)), S.lit(False)), f"invalid {name}")

    cwd, paths, command = S.ref("cwd"), S.ref("paths"), S.ref("command")
    tests = [
        S.ref("error"),
        S.when(S.coalesce(S.ref("protocol") != 1, S.lit(True)), "unsupported protocol"),
        required("agent"), required("event"), required("tool_name"), optional("session_id"), optional("call_id"),
        S.when(S.coalesce(~is_absolute(cwd) | (S.octet_length(cwd) > MAX_PATH_BYTES) | S.contains(cwd, "\0"), S.lit(True)),
               "invalid cwd"),
        S.when(S.size(paths) > MAX_LIST, "too many paths"),
        S.when(S.exists(paths, lambda p: (p == "") | (S.octet_length(p) > MAX_PATH_BYTES) | S.contains(p, "\0")),
               "invalid path"),
        S.when((S.octet_length(command) > MAX_STRING_BYTES) | S.contains(command, "\0"), "invalid command"),
        S.when(S.exists(S.ref("urls"), lambda u: (S.octet_length(u) > MAX_STRING_BYTES) | S.contains(u, "\0")), "invalid url"),
    ]
    if "input" in calls.columns:
        tests.append(S.when(S.exists(nodes(S.ref("input")), lambda n: (
            S.octet_length(S.try_variant_get(n["value"], "$", "string")) > MAX_STRING_BYTES)
            | S.schema_of_variant(n["value"]).rlike("^(?:OBJECT|ARRAY)<.")), "input too large or too deep"))
    reasons = S.col(S.filter(S.array(*tests), lambda r: r.isNotNull())).alias("reasons")
    # As a generated row the tests run once, also for the filters of split_valid.
    return calls.select("*", F.inline_outer(F.array(F.struct(reasons))))


def split_valid(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid calls, quarantined calls with their reasons)."""
    judged = defects(calls)
    return judged.where("size(reasons) = 0").drop("reasons", "error"), judged.where("size(reasons) > 0")
