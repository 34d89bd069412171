"""Registered queries on command and query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.functions import sql as S
from warden.functions.calls import tool_sink
from warden.functions.decisions import RuleSet
from warden.operators import commands, queries
from warden.plans.derived import CALLS, COMMANDS, CONFIGURED_TABLES, SQL_TEXTS, SQL_WORDS, calls, golden, pick, sql
from warden.plans.registry import query

R = S.ref
C = sql(CALLS)


def shell_calls(spark, folder):
    none = F.expr("cast(array() as array<string>)")
    return calls(spark, folder).select(
        "call_id", "cwd", "command_no", F.lit("Bash").alias("tool_name"), F.lit("shell_execute").alias("capability"),
        F.array("command").alias("commands"), none.alias("queries"), none.alias("urls"))


@query("p12_query_statements", f"""
with c as ({C}) select query_no, count(*) as n from c group by query_no""")
def p12(spark, folder):
    words = queries.statements(calls(spark, folder).select("call_id", "query", "query_no"))
    per_call = words.groupBy("call_id").agg(F.max("stmt_pos").alias("last"))
    return calls(spark, folder).select("call_id", "query_no").join(per_call, "call_id").groupBy("query_no").agg(
        F.count("*").alias("n"))


@query("p12_query_words", f"""
with c as ({C}) select call_id, {pick(SQL_WORDS, 'k + event_id * 3').replace('event_id', 'call_id')} as words from c""")
def p12_words(spark, folder):
    words = queries.statements(calls(spark, folder).select("call_id", "query"))
    placed = F.struct("stmt_pos", F.coalesce(F.array_join("words", " "), F.lit("-")).alias("w"))
    return words.groupBy("call_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(placed)), lambda s: s["w"]), ";").alias("words"))


@query("p13_query_verdicts", f"""
with c as ({C}) select call_id, {golden(SQL_TEXTS, 1, 'query_no')} as effect, {golden(SQL_TEXTS, 2, 'query_no')} as rule_id from c""")
def p13(spark, folder):
    return queries.verdicts(calls(spark, folder), CONFIGURED_TABLES)


@query("j6_sensitive_tables", f"""
with c as ({C}), t as (select call_id, unnest(string_split({golden(SQL_TEXTS, 3, 'query_no')}, ',')) as table_name from c)
select call_id, table_name from t where table_name <> ''""")
def j6(spark, folder):
    return queries.sources(calls(spark, folder), CONFIGURED_TABLES).select("call_id", "table_name")


@query("a9_table_categories", f"""
with c as ({C}), t as (select call_id, unnest(string_split({golden(SQL_TEXTS, 3, 'query_no')}, ',')) as table_name from c)
select table_name, case
  when regexp_matches(table_name, '(users|user__|sessions$|flood$)') then 'credential,authentication,personal_data'
  when regexp_matches(table_name, 'commerce_(payment|order|shipment)') then 'personal_data,financial_data,customer_data'
  when regexp_matches(table_name, '(webform_submission|comment|profile)') then 'personal_data,customer_data'
  when regexp_matches(table_name, '(watchdog|key_value|key_value_expire)$') then 'operational_sensitive'
  else 'unknown_sensitive' end as categories, count(*) as n
from t where table_name <> '' group by all""")
def a9(spark, folder):
    return queries.sources(calls(spark, folder), CONFIGURED_TABLES).groupBy(
        "table_name", F.array_join("categories", ",").alias("categories")).agg(F.count("*").alias("n"))


@query("p17_command_verdicts", f"""
with c as ({C}) select call_id, {golden(COMMANDS, 1, 'command_no')} as effect, {golden(COMMANDS, 2, 'command_no')} as rule_id from c""")
def p17(spark, folder):
    return commands.verdicts(shell_calls(spark, folder), RuleSet()).select(
        "call_id", F.coalesce("decision.effect", F.lit("allow")).alias("effect"),
        F.coalesce("decision.rule_id", F.lit("none")).alias("rule_id"))


@query("p14_command_segments")
def p14(spark, folder):
    return commands.segments(shell_calls(spark, folder)).select(
        "call_id", F.array_join("pos", ".").alias("place"), "kind", F.array_join("argv", " ").alias("argv"), "cwd", "rule")


@query("p18_command_operands")
def p18(spark, folder):
    found = commands.operands(commands.segments(shell_calls(spark, folder)))
    return found.groupBy("operation", "path", "tree", "rule").agg(F.count("*").alias("n"))


@query("j4_operand_rules", f"""
with c as ({C}) select {golden(COMMANDS, 2, 'command_no')} as rule_id, count(*) as n_calls from c
where {golden(COMMANDS, 2, 'command_no')} like '%.secret.%' or {golden(COMMANDS, 2, 'command_no')} like 'filesystem.write.%'
  or {golden(COMMANDS, 2, 'command_no')} = 'ddev.context.unknown' group by all""")
def j4(spark, folder):
    found = commands.decided(commands.operands(commands.segments(shell_calls(spark, folder))))
    return (
        commands.strongest(found.where("path is not null")).groupBy(F.col("decision.rule_id").alias("rule_id"))
        .agg(F.count("*").alias("n_calls")))


@query("p25_command_sinks", f"""
with c as ({C}) select call_id, {golden(COMMANDS, 3, 'command_no')} as sink from c where {golden(COMMANDS, 3, 'command_no')} <> ''""")
def p25(spark, folder):
    return commands.sinks(shell_calls(spark, folder))


@query("p25_tool_sinks", f"""
with c as ({C}), t as (select call_id, lower(native_tool) as low, k % 2 = 0 as has_url,
   case when lower(native_tool) in ('webfetch','websearch') then 'network_read' else 'unknown' end as kind from c)
select call_id, case when regexp_matches(low, '^mcp(__|:)') then 'outbound_mcp' when kind = 'network_read' then
   case when has_url then 'outbound_http' else '' end
  when contains(low, 'mcp') then 'outbound_mcp' when regexp_matches(low, 'upload|browser') then 'browser_upload'
  when regexp_matches(low, 'slack|email|message') then 'messaging'
  when regexp_matches(low, 'issue|ticket|linear|github|gitlab') then 'api_submission'
  when regexp_matches(low, 'http|fetch|request') then 'outbound_http' else '' end as sink from t""")
def p25_tools(spark, folder):
    kind = S.when(S.lower(R("native_tool")).isin("webfetch", "websearch"), "network_read").otherwise("unknown")
    return calls(spark, folder).select("call_id", S.col(S.coalesce(
        tool_sink(R("native_tool"), kind, S.expr("k % 2 = 0")), S.lit(""))).alias("sink"))
