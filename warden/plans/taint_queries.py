"""Registered queries on sessions (W1-W4, A5-A8, O5, J7, slice 0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden import session
from warden.functions import sql as S
from warden.operators import commands, replay, taint
from warden.plans.derived import CALLS, COMMANDS, CONFIGURED_TABLES, SHOWN, SQL_TEXTS, calls, golden, sql
from warden.functions.decisions import BUILT_IN, RuleSet
from warden.plans.path_queries import BUILT_IN_SQL, rule_ladder
from warden.plans.registry import query
from warden.vocab import CATEGORIES

R = S.ref
C = sql(CALLS)
READ_RULES = [r for r in BUILT_IN_SQL if r[1] == "read"]
SOURCE = rule_ladder("normal_path", "'file_read'", "''", READ_RULES)
ORDER = "partition by agent, session_id order by ts, seq rows between unbounded preceding and 1 preceding"
TABLE_CATS = """case when regexp_matches(t, '(users|user__|sessions$|flood$)') then 'credential,authentication,personal_data'
  when regexp_matches(t, 'commerce_(payment|order|shipment)') then 'personal_data,financial_data,customer_data'
  when regexp_matches(t, '(webform_submission|comment|profile)') then 'personal_data,customer_data'
  when regexp_matches(t, '(watchdog|key_value|key_value_expire)$') then 'operational_sensitive' else 'unknown_sensitive' end"""
PATH_CATS = f"""case when {SOURCE} = 'drupal.secret.settings_php' then 'credential,authentication,operational_sensitive'
  when {SOURCE} <> '' then 'credential,authentication' else '' end"""
#: Every kind of source: paths, commands and the queries of MCP tools.
FLAGS = f"""
shown as (select *, case capability
    when 'shell_execute' then {golden([(c, SHOWN.get(c[0], "")) for c in COMMANDS], 1, 'command_no')}
    when 'mcp_call' then {PATH_CATS} || ',' || coalesce((select string_agg({TABLE_CATS}, ',')
      from (select unnest(string_split({golden(SQL_TEXTS, 3, 'query_no')}, ',')) as t) where t <> ''), '')
    else {PATH_CATS} end as cats from ({C})),
flags as (select *, string_split(cats, ',') as own,
  case capability when 'network_write' then 'outbound_network' when 'mcp_call' then 'outbound_mcp'
    when 'shell_execute' then nullif({golden(COMMANDS, 3, 'command_no')}, '') end as sink,
  case when capability = 'shell_execute' then case when {golden(COMMANDS, 1, 'command_no')} = 'allow' then 'default.no_matching_rule'
      else {golden(COMMANDS, 2, 'command_no')} end
    when capability = 'mcp_call' and {golden(SQL_TEXTS, 1, 'query_no')} <> 'allow' then {golden(SQL_TEXTS, 2, 'query_no')}
    else {rule_ladder('normal_path')} end as rule_id from shown),
known as (select *, {', '.join(f"coalesce(bool_or(list_contains(own, '{c}')) over ({ORDER}), false) as had_{c}" for c in CATEGORIES)}
  from flags),
w as (select *, concat_ws(',', {', '.join(f"case when had_{c} then '{c}' end" for c in CATEGORIES)}) as prior,
  cats <> '' and regexp_matches(cats, '[a-z]') as touches,
  case when rule_id = 'default.no_matching_rule' then 'allow'
    when capability = 'shell_execute' then {golden(COMMANDS, 1, 'command_no')} else 'deny' end as effect from known),
v as (select *, prior <> '' and sink is not null as hot, replace(prior, 'operational_sensitive', '') <> '' as grave from w),
e as (select *, case when hot and grave and effect <> 'deny' then 'exfiltration.tainted_session'
    when hot and not grave and effect = 'allow' then 'exfiltration.tainted_session.review' else rule_id end as enforced_rule_id,
  case when hot and grave then 'deny' when hot and effect = 'allow' then 'ask' else effect end as enforced_effect from v)"""
TABLES = RuleSet(BUILT_IN, CONFIGURED_TABLES)


def with_taint(log):
    """Calls with what they show, where they send and what was decided; all inside the row."""
    none = F.expr("cast(array() as array<string>)")
    given = lambda kind, column: F.when(F.col("capability") == kind, F.array(column)).otherwise(none)
    ready = log.withColumns({
        "commands": given("shell_execute", "command"), "queries": given("mcp_call", "query"), "urls": none,
        "paths": F.when(F.col("capability") == "shell_execute", none).otherwise(F.array("path"))})
    return taint.call_categories(commands.with_flow(ready), TABLES)


def tainted_calls(spark, folder):
    return with_taint(calls(spark, folder))


def decided(log):
    """Calls with their decision. What they show and where they send becomes a generated row before: a filter on it is
    asked ahead of the decision, and computes nothing a second time."""
    flow = ("sink", "source_categories")
    ready = log.select(*[c for c in log.columns if c not in flow], F.inline(F.array(F.struct(*flow))))
    return replay.decide(commands.with_call_decision(ready, "by_command", TABLES), RuleSet(), "by_command")


def enforced(spark, folder):
    """Enforced decisions. Taint joins the calls with their own first moments, so what was decided is saved for both sides."""
    rows = decided(tainted_calls(spark, folder)).select(
        "call_id", "agent", "session_id", "ts", "seq", "source_categories", "sink", "effect", "rule_id")
    return taint.enforce(taint.prior(session.saved(rows, "decided")))


@query("slice0_exfiltration", f"""
with {FLAGS} select enforced_rule_id, count(*) as n_calls, count(distinct session_id) as n_sessions from e group by all""")
def slice0(spark, folder):
    per_session = enforced(spark, folder).groupBy("enforced_rule_id", "session_id").agg(F.count("*").alias("n"))
    return per_session.groupBy("enforced_rule_id").agg(
        F.sum("n").alias("n_calls"), F.count("*").alias("n_sessions"))


@query("w1_taint_before_call", f"with {FLAGS} select call_id, prior from w")
def w1(spark, folder):
    return taint.prior(tainted_calls(spark, folder)).select("call_id", F.array_join("prior", ",").alias("prior"))


@query("w2_exfiltration_decisions", f"with {FLAGS} select call_id, rule_id, sink, enforced_rule_id, enforced_effect from e")
def w2(spark, folder):
    return enforced(spark, folder).select("call_id", "rule_id", "sink", "enforced_rule_id", "enforced_effect")


@query("w3_taint_distance", f"""
with {FLAGS}, n as (select *, row_number() over (partition by agent, session_id order by ts, seq) as rn from w),
t as (select agent, session_id, min(rn) filter (where touches) as t_rn, min(rn) filter (where prior <> '' and sink is not null) as o_rn
  from n group by all having min(rn) filter (where touches) is not null)
select agent, session_id, a.call_id as taint_call, b.call_id as outbound_call, coalesce(o_rn - t_rn, 0) as calls_between
from t join n a using (agent, session_id) left join n b on b.agent = t.agent and b.session_id = t.session_id and b.rn = o_rn
where a.rn = t_rn""")
def w3(spark, folder):
    return taint.distances(tainted_calls(spark, folder))


def source_rows(spark, folder):
    log = calls(spark, folder).select(
        "call_id", "agent", "session_id", "ts", "seq", "cwd", F.array("path").alias("paths"), F.array("query").alias("sql_texts"))
    return taint.sources(log, RuleSet(BUILT_IN, CONFIGURED_TABLES))


SOURCES_SQL = f"""
c as ({C}), s as (
 select call_id, agent, session_id, ts, seq, {SOURCE} as source_id, 'file' as resource_kind, 'sha256:' || sha256(normal_path) as resource,
   case when {SOURCE} = 'drupal.secret.settings_php' then 'credential,authentication,operational_sensitive' else 'credential,authentication' end as categories
 from c where {SOURCE} <> ''
 union all
 select call_id, agent, session_id, ts, seq, 'sql.read.sensitive_table', 'sql_table', 'sha256:' || sha256(t), {TABLE_CATS}
 from (select *, unnest(string_split({golden(SQL_TEXTS, 3, 'query_no')}, ',')) as t from c) where t <> '')"""


@query("a6_sources", f"with {SOURCES_SQL} select call_id, source_id, resource_kind, resource, categories from s")
def a6(spark, folder):
    return source_rows(spark, folder).select(
        "call_id", "source_id", "resource_kind", "resource", F.array_join("categories", ",").alias("categories"))


@query("a8_path_source_categories", f"""
with c as ({C}) select {SOURCE} as source_id, count(*) as n, count(distinct normal_path) as n_paths from c where {SOURCE} <> '' group by 1""")
def a8(spark, folder):
    files = source_rows(spark, folder).where("resource_kind = 'file'")
    return files.groupBy("source_id", "resource").agg(F.count("*").alias("n")).groupBy("source_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_paths"))


@query("a7_session_rollup", f"""
with {SOURCES_SQL}, d as (select agent, session_id, source_id, resource, min(ts) as f, max(ts) as l, min(categories) as categories
  from s group by all), x as (select *, unnest(string_split(categories, ',')) as category from d)
select agent, session_id, min(f) as created_ts, max(l) as updated_ts, count(distinct resource || source_id) as n_sources,
  array_to_string(list_filter(['credential','authentication','personal_data','financial_data','customer_data','private_content',
   'operational_sensitive','unknown_sensitive'], lambda c: list_contains(list(distinct category), c)), ',') as categories
from x group by agent, session_id""")
def a7(spark, folder):
    return taint.sessions(source_rows(spark, folder)).select(
        "agent", "session_id", "created_ts", "updated_ts", "n_sources", F.array_join("categories", ",").alias("categories"))


@query("w4_last_sources", f"""
with {SOURCES_SQL}, d as (select agent, session_id, source_id, resource, min((ts, seq)) as f from s group by all),
r as (select *, row_number() over (partition by agent, session_id order by f desc, source_id, resource) as n from d)
select agent, session_id, source_id, resource from r where n <= 32""")
def w4(spark, folder):
    return taint.sessions(source_rows(spark, folder)).select(
        "agent", "session_id", F.explode("sources").alias("x")).select("agent", "session_id", "x.source_id", "x.resource")


@query("o5_session_integrity", f"with {SOURCES_SQL} select count(distinct agent || session_id) as n_sessions, 0 as n_broken from s")
def o5(spark, folder):
    found = source_rows(spark, folder)
    rolled = taint.sessions(found)
    broken = taint.integrity(found, rolled).agg(F.count("*").cast("int").alias("n_broken"))
    return rolled.agg(F.count("*").alias("n_sessions")).withColumn("k", F.lit(1)).join(
        broken.withColumn("k", F.lit(1)), "k").drop("k")
