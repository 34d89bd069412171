"""Registered queries on envelopes, audit records and masked tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from warden import session
from warden.functions import sql as S
from warden.functions.decisions import rank
from warden.functions.fields import ScanConfig
from warden.operators import mask, replay, taint
from warden.plans.derived import CALLS, derive, sql
from warden.plans.path_queries import file_calls, rule_ladder
from warden.plans.registry import load, query
from warden.plans.taint_queries import PATH_CATS, SOURCE
from warden.sources import audit_lake, calls as logs
from warden.vocab import BUILT_IN_RULES

C = sql(CALLS)
Q = '"'
SHELL_TEXT = "'ls p' || cast(k as string)"
ENVELOPES = {
    "codex": f"""'{{{{"session_id":"s' || session_id || '","cwd":"' || cwd || '","hook_event_name":"' || case when k % 9 = 0 then 'Stop' else 'PreToolUse' end
 || '","tool_name":"' || native_tool || '","tool_use_id":"' || cast(call_id as string) || '","tool_input":{{{{"command":"' || case when native_tool = 'apply_patch'
 then '*** Add File: n' || cast(k as string) || '.txt' else {SHELL_TEXT} end || '","file_path":"' || path || '"}}}}}}}}'""",
    "cursor": f"""'{{{{"conversation_id":"s' || session_id || '","cwd":"' || cwd || '","tool_name":"' || native_tool || '","tool_use_id":"' || cast(call_id as string)
 || '","tool_input":{{{{"working_directory":"' || case when k % 4 = 0 then 'sub/../app' else '.' end || '","command":"' || {SHELL_TEXT} || '","path":"' || path || '"}}}}}}}}'""",
    "opencode": f"""'{{{{"schema":' || case when k % 8 = 0 then '2' else '1' end || ',"session_id":"s' || session_id || '","call_id":"' || cast(call_id as string)
 || '","cwd":"' || cwd || '","tool_name":"' || native_tool || '","tool_input":{{{{"command":"' || {SHELL_TEXT} || '","patchText":"*** Delete File: d' || cast(k as string)
 || '.txt","filePath":"' || path || '","url":"http://x.test/' || cast(k as string) || '"}}}}}}}}'""",
}


def envelopes(spark, folder, agent):
    text = derive(spark, folder, f"select *, {ENVELOPES[agent]} as body from ({CALLS}) where agent = '{agent}'")
    return text.select(F.from_json("body", logs.ENVELOPES[agent]).alias("e")).select("e.*")


SHOWN = ["session_id", "call_id", "cwd", "capability", "paths", "command", "urls", "error"]


def shown(df):
    text = lambda name: F.coalesce(F.array_join(name, ","), F.lit("")).alias(name)
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("session_id", "call_id", "cwd", "capability", "command", "error")]
    return df.select(*plain, text("paths"), text("urls"))


FILES = "('file_read','file_write','file_delete')"
CODEX_KIND = r"""case when native_tool = 'Bash' then 'shell_execute' when native_tool = 'apply_patch' then 'file_write'
   when regexp_matches(lower(native_tool), '(^|__)(read|read_file|read_text_file|get_file)$') then 'file_read'
   when regexp_matches(lower(native_tool), '(^|__)(write|write_file|write_text_file|create_file|edit_file)$') then 'file_write'
   when regexp_matches(lower(native_tool), '(^|__)(delete|delete_file|remove_file)$') then 'file_delete'
   when regexp_matches(lower(native_tool), '^mcp__') then 'mcp_call' else 'unknown' end"""
CURSOR_KIND = """case lower(native_tool) when 'shell' then 'shell_execute' when 'read' then 'file_read' when 'write' then 'file_write' when 'edit' then 'file_write'
   when 'delete' then 'file_delete' else case when lower(native_tool) like 'mcp:%' then 'mcp_call' else 'unknown' end end"""
OPENCODE_KIND = """case lower(native_tool) when 'bash' then 'shell_execute' when 'read' then 'file_read' when 'write' then 'file_write' when 'edit' then 'file_write'
   when 'apply_patch' then 'file_write' when 'webfetch' then 'network_read' when 'websearch' then 'network_read' else 'unknown' end"""
CALLS_SQL = {
    "codex": f"""select 's' || session_id as session_id, cast(call_id as varchar) as call_id, cwd, kind as capability,
  case when native_tool = 'apply_patch' then 'n' || k || '.txt' when kind in {FILES} or kind = 'mcp_call' then path else '' end as paths,
  case when kind = 'shell_execute' then 'ls p' || k else '' end as command, '' as urls, case when k % 9 = 0 then 'wrong event' else '' end as error
  from (select *, {CODEX_KIND} as kind from ({C}) where agent = 'codex')""",
    "cursor": f"""select 's' || session_id as session_id, cast(call_id as varchar) as call_id, cwd || case when k % 4 = 0 then '/app' else '' end as cwd, kind as capability,
  case when kind = 'shell_execute' then '' else path end as paths, case when kind = 'shell_execute' then 'ls p' || k else '' end as command, '' as urls, '' as error
  from (select *, {CURSOR_KIND} as kind from ({C}) where agent = 'cursor')""",
    "opencode": f"""select 's' || session_id as session_id, cast(call_id as varchar) as call_id, cwd, kind as capability,
  case when kind = 'shell_execute' then '' when lower(native_tool) = 'apply_patch' then 'd' || k || '.txt' else path end as paths,
  case when kind = 'shell_execute' then 'ls p' || k else '' end as command, case when kind = 'network_read' then 'http://x.test/' || k else '' end as urls,
  case when k % 8 = 0 then 'unsupported schema' else '' end as error from (select *, {OPENCODE_KIND} as kind from ({C}) where agent = 'opencode')""",
}


@query("s1_codex_calls", CALLS_SQL["codex"])
def s1(spark, folder):
    return shown(logs.canonical(envelopes(spark, folder, "codex"), "codex"))


@query("s2_cursor_calls", CALLS_SQL["cursor"])
def s2(spark, folder):
    return shown(logs.canonical(envelopes(spark, folder, "cursor"), "cursor"))


@query("s3_opencode_calls", CALLS_SQL["opencode"])
def s3(spark, folder):
    return shown(logs.canonical(envelopes(spark, folder, "opencode"), "opencode"))


def unified(spark, folder):
    return logs.unify(*[logs.canonical(envelopes(spark, folder, a), a) for a in ENVELOPES])


ALL_SQL = " union all ".join(f"select '{a}' as agent, * from ({q})" for a, q in CALLS_SQL.items())


@query("s5_unified_calls", f"select agent, capability, count(*) as n, count(distinct session_id) as n_sessions from ({ALL_SQL}) group by all")
def s5(spark, folder):
    per = unified(spark, folder).groupBy("agent", "capability", "session_id").agg(F.count("*").alias("n"))
    return per.groupBy("agent", "capability").agg(F.sum("n").alias("n"), F.count("*").alias("n_sessions"))


@query("s6_quarantined_calls", f"""
select agent, call_id, error as reasons from ({ALL_SQL}) where error <> ''""")
def s6(spark, folder):
    _, bad = logs.split_valid(unified(spark, folder))
    return bad.select("agent", "call_id", F.array_join("reasons", ",").alias("reasons"))


RESULT_BODY = """'{{"session_id":"s' || session_id || '","cwd":"' || cwd || '","hook_event_name":"PostToolUse","tool_name":"read_file","tool_use_id":"' || cast(call_id as string)
 || '","tool_input":{{"path":"' || path || '"}},"tool_response":{{"k":' || cast(k as string) || ',"t":"é"}}}}'"""


@query("s4_tool_results", f"""
with c as ({C}) select cast(call_id as varchar) as call_id, path, 'completed' as status, 8 + cast(length(cast(k as varchar)) as bigint) + 7 as byte_size from c""")
def s4(spark, folder):
    text = derive(spark, folder, f"select {RESULT_BODY} as body from ({CALLS})")
    rows = text.select(F.from_json("body", logs.ENVELOPES["codex"] + logs.RESULTS["codex"]).alias("e")).select("e.*")
    return logs.with_result(rows, "codex").select(
        "call_id", F.element_at("paths", 1).alias("path"), "result.status", "result.byte_size")


MORE_RESULTS = {
    "cursor": """'{{"conversation_id":"s","cwd":"' || cwd || '","tool_name":"Read","tool_use_id":"' || cast(call_id as string) ||
 '","tool_input":{{"path":"' || path || '"}},"tool_output":"' || repeat('é', cast(k % 50 as int)) || '","duration":5}}'""",
    "opencode": """'{{"schema":1,"session_id":"s","call_id":"' || cast(call_id as string) || '","cwd":"' || cwd ||
 '","tool_name":"read","tool_input":{{"filePath":"' || path || '"}},"status":"' || case when k % 5 = 0 then 'error' else 'completed' end ||
 '","content_type":"text/plain","byte_size":' || cast(k as string) || '}}'""",
}


@query("s4_results_of_all_agents", f"""
select 'cursor' as agent, cast(call_id as varchar) as call_id, path, 'completed' as status, 'application/json' as content_type,
  cast(2 * (k % 50) as bigint) as byte_size from ({C})
union all select 'opencode', cast(call_id as varchar), path, case when k % 5 = 0 then 'error' else 'completed' end, 'text/plain',
  cast(k as bigint) from ({C})""")
def s4_all(spark, folder):
    out = []
    for agent, body in MORE_RESULTS.items():
        text = derive(spark, folder, f"select {body} as body from ({CALLS})")
        rows = text.select(F.from_json("body", logs.ENVELOPES[agent] + logs.RESULTS[agent]).alias("e")).select("e.*")
        out.append(logs.with_result(rows, agent).select(
            F.lit(agent).alias("agent"), "call_id", F.element_at("paths", 1).alias("path"), "result.status",
            "result.content_type", "result.byte_size"))
    return logs.unify(*out)


CANDIDATE_BODY = """'{{"schema":1,"session_id":"s","call_id":"' || cast(call_id as string) || '","cwd":"' || cwd || '","tool_name":"Task","tool_input":{{"cmd":"ls","files":["' || path || '"],"sql":' ||
 case when k % 6 = 0 then '1' else '"select 1"' end || '}}}}'"""


@query("o3_facts_and_candidates", f"""
with c as ({C}) select cast(call_id as varchar) as call_id, path || ',' || path as paths, 'ls' as commands, case when k % 6 = 0 then '' else 'select 1' end as queries,
 case when k % 6 = 0 then 'query is not text' else '' end as error from c""")
def o3(spark, folder):
    text = derive(spark, folder, f"select {CANDIDATE_BODY} as body from ({CALLS})")
    rows = text.select(F.from_json("body", logs.ENVELOPES["opencode"]).alias("e")).select("e.*")
    full = logs.with_candidates(logs.canonical(rows, "opencode"))
    return full.select("call_id", *[F.array_join(c, ",").alias(c) for c in ("paths", "commands", "queries")],
                       F.coalesce("error", F.lit("")).alias("error"))


AUDIT_LINES = """
select event_id, '{{"schema":' || cast(event_id % 4 + 1 as string) || ',"agent":"codex","event":"' ||
 case when event_id % 10 = 0 then 'post_tool_use' when event_id % 10 = 1 then 'result_containment' else 'pre_tool_use' end || '","decision":"' ||
 case when event_type = 'error' then 'deny' else 'allow' end || '","rule_id":"r' || cast(user_id as string) || '"' ||
 case when event_id % 4 > 0 then ',"mode":"audit_only","enforcement_decision":"allow","enforcement_rule_id":"none"' else '' end || '}}' as line from {events}"""


@query("s11_read_audit", """
select event_id, case when event_id % 10 in (0, 1) and event_id % 4 = 0 then '' when event_id % 4 = 0 then 'enforce' else 'audit_only' end as mode,
  case when event_id % 4 > 0 then 'allow' when event_id % 10 in (0, 1) then '' when event_type = 'error' then 'deny' else 'allow' end as enforcement_decision,
  case when event_id % 4 > 0 then 'none' when event_id % 10 in (0, 1) then '' else 'r' || user_id end as enforcement_rule_id from events""")
def s11(spark, folder):
    parsed = derive(spark, folder, AUDIT_LINES).select("event_id", F.from_json("line", audit_lake.AUDIT_SCHEMA).alias("r")).select(
        "event_id", "r.*")
    return audit_lake.complete(parsed).select("event_id", *[F.coalesce(c, F.lit("")).alias(c) for c in (
        "mode", "enforcement_decision", "enforcement_rule_id")])


@query("s10_audit_records", f"""
select 'sha256:' || sha256(cast(call_id as varchar)) as call, 'sha256:' || sha256(session_id) as session, agent, epoch_us(ts) // 1000 as timestamp_unix_ms,
 capability from ({C})""")
def s10_records(spark, folder):
    decided = replay.decide(file_calls(spark, folder).drop("project"))
    return audit_lake.pre_records(decided).select("call", "session", "agent", "timestamp_unix_ms", "capability")


_RULES = {rule: (category, severity) for rule, category, _, severity, _, _ in BUILT_IN_RULES}
_ONE_OF = lambda place: "case rule_id " + " ".join(
    f"when '{rule}' then '{values[place]}'" for rule, values in _RULES.items()) + f" else '{('default', 'info')[place]}' end"
RESULT_TYPE = "case k % 3 when 0 then 'application/json' when 1 then 'text/html; odd' end"
AUDITED = f"""
c as (select *, 'sha256:' || sha256(session_id) as session, 'sha256:' || sha256(cast(call_id as varchar)) as call,
  epoch_us(ts) // 1000 as timestamp_unix_ms, strftime(ts, '%Y-%m-%d') as day,
  {rule_ladder('normal_path')} as rule_id, {SOURCE} as source, {PATH_CATS} as cats from ({C})),
p as (select *, case when rule_id = 'default.no_matching_rule' then 'allow' else 'deny' end as decision from c)"""


@query("s10_audit_lake", f"""
with {AUDITED}
select 4 as schema, timestamp_unix_ms, agent, 'pre_tool_use' as event, session, call, capability, decision, rule_id,
  {_ONE_OF(0)} as category, {_ONE_OF(1)} as severity,
  case when rule_id = 'default.no_matching_rule' then 'default' else 'built_in' end as policy_layer, 'enforce' as mode,
  decision as enforcement_decision, rule_id as enforcement_rule_id, '' as result_status, '' as result_content_type,
  cast(-1 as bigint) as result_byte_size, '' as source_ids, '' as sensitivity_categories, -1 as exit_code, day from p
union all
select 4, timestamp_unix_ms, agent, 'post_tool_use', session, call, capability, 'recorded', '', '', '', '', '', '', '', 'completed',
  coalesce(case k % 3 when 0 then 'application/json' when 1 then 'unknown' end, ''), cast(k as bigint), source, cats, -1, day from p
union all
select 4, timestamp_unix_ms, agent, 'result_containment', session, '', '', case when cats <> '' then 'sanitize' else 'allow' end,
  '', '', '', '', '', '', '', '', '', -1, source, cats, cast(k % 4 as int), day from p""")
def s10(spark, folder):
    """Records of three kinds, written to one partitioned log and read back, in all their columns."""
    log = taint.call_categories(file_calls(spark, folder).drop("project"))
    sources = taint.path_source(S.ref("normal_path"))
    facts = log.withColumn("source_ids", S.col(S.filter(S.array(sources), lambda x: x.isNotNull()))).withColumn(
        "sensitivity_categories", F.col("source_categories"))
    results = facts.withColumn("result", F.struct(
        F.lit("completed").alias("status"), F.expr(RESULT_TYPE).alias("content_type"), F.col("k").cast("bigint").alias("byte_size")))
    contained = facts.withColumn("decision", F.when(F.size("source_ids") > 0, "sanitize").otherwise("allow")).withColumn(
        "exit_code", F.col("k") % 4)
    path = os.path.join(session.checkpoint_dir(spark), f"audit-log-{uuid.uuid4().hex}")
    audit_lake.write_audit(audit_lake.all_records(
        audit_lake.pre_records(replay.decide(log)), audit_lake.post_records(results), audit_lake.result_records(contained)), path)
    text = ("session", "call", "capability", "rule_id", "category", "severity", "policy_layer", "mode", "enforcement_decision",
            "enforcement_rule_id", "result_status", "result_content_type")
    back = audit_lake.read_audit(spark, path)
    return back.select(
        "schema", "timestamp_unix_ms", "agent", "event", "decision", *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.coalesce("result_byte_size", F.lit(-1)).alias("result_byte_size"), F.coalesce("exit_code", F.lit(-1)).alias("exit_code"),
        *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("source_ids", "sensitivity_categories")],
        F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("f19_pseudonyms", "select c_custkey, 'sha256:' || sha256(c_name) as name from customer")
def f19(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", audit_lake.pseudonymize(F.col("c_name")).alias("name"))


@query("f20_closed_lists", f"""
with c as ({C}) select case when agent in ('codex', 'cursor') then agent else 'unknown' end as agent,
  case when event_type = 'view' then 'pre_tool_use' else 'unknown' end as event, count(*) as n from c group by all""")
def f20(spark, folder):
    log = derive(spark, folder, CALLS).select(
        F.when(F.col("agent") == "opencode", "other").otherwise(F.col("agent")).alias("agent"),
        F.when(F.col("event_type") == "view", "pre_tool_use").otherwise(F.col("event_type")).alias("event"))
    return log.groupBy(*[S.col(audit_lake.known(S.ref(c), c)).alias(c) for c in ("agent", "event")]).agg(F.count("*").alias("n"))


@query("f21_effect_ranks", "select case event_type when 'error' then 'deny' when 'click' then 'ask' else 'allow' end as effect, max(case event_type when 'error' then 2 when 'click' then 1 else 0 end) as effect_rank, count(*) as n from events group by 1")
def f21(spark, folder):
    effect = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "click", "ask").otherwise("allow")
    return load(spark, folder, "events").groupBy(effect.alias("effect")).agg(F.count("*").alias("n")).withColumn(
        "effect_rank", S.col(rank(S.ref("effect"))))


NESTED = """
select o_orderkey as k, named_struct('password', o_orderkey, 'note', 'mail u' || cast(o_custkey as string) || '@x.test now', 'items', array(
  named_struct('iban', 'BE' || cast(o_orderkey as string), 'qty', o_custkey))) as body,
  named_struct('city', 'X', 'zip', o_custkey) as billing_address, map('token', cast(o_custkey as string), 'size', 'L') as attrs,
  array('a' || cast(o_custkey as string), null) as phone, case when o_orderkey % 3 = 0 then null else 'x' end as secret from {orders}"""


@query("f17_masked_columns", """
select o_orderkey as k, '[REDACTED:CREDENTIAL]' as password, 'mail [REDACTED:PERSONAL_DATA] now' as note, '[REDACTED:FINANCIAL_DATA]' as iban, o_custkey as qty,
 '[REDACTED:CUSTOMER_DATA]' as city, '[REDACTED:CREDENTIAL]' as token, 'L' as size, '[REDACTED:PERSONAL_DATA],-' as phone,
 case when o_orderkey % 3 = 0 then '-' else '[REDACTED:CREDENTIAL]' end as secret from orders""")
def f17(spark, folder):
    done = mask.mask_columns(derive(spark, folder, NESTED), ScanConfig())
    return done.select(
        "k", "body.password", "body.note", F.col("body.items")[0]["iban"].alias("iban"), F.col("body.items")[0]["qty"].alias("qty"),
        F.expr("billing_address.`[REDACTED:CUSTOMER_DATA]:key0`").alias("city"), F.col("attrs")["token"].alias("token"),
        F.col("attrs")["size"].alias("size"), F.array_join("phone", ",", "-").alias("phone"),
        F.coalesce("secret", F.lit("-")).alias("secret"))


@query("f18_masked_tables", "select c_custkey, '[REDACTED:UNKNOWN_SENSITIVE]' as c_name, '[REDACTED:UNKNOWN_SENSITIVE]' as c_acctbal from customer")
def f18(spark, folder):
    return mask.mask_all(load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), keep=("c_custkey",))


@query("p22_missing_exclusions", f"""
with c as ({C}) select call_id, 27 - list_count(list_distinct(list_filter([case when k % 2 = 0 then '**/.env' end, case when k % 3 = 0 then '**/*.pem' end], lambda x: x is not null))) as n_open from c""")
def p22(spark, folder):
    from warden.functions.programs import excluded
    from warden.functions.decisions import RuleSet
    from warden.operators.commands import protected_reads
    args = S.concat(
        S.array("-g", "*.php"), S.when(S.expr("k % 2 = 0"), S.array("-g", "!**/.env")).otherwise(S.expr("cast(array() as array<string>)")),
        S.when(S.expr("k % 3 = 0"), S.array("--glob=!**/*.pem")).otherwise(S.expr("cast(array() as array<string>)")))
    protected = S.array(*protected_reads(RuleSet()))
    return derive(spark, folder, CALLS).select("call_id", S.col(S.size(S.array_except(protected, excluded(args)))).alias("n_open"))
