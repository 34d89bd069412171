"""Registered queries on rules, audit records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.operators import audit, replay, rules
from warden.plans.derived import CALLS, calls, derive, pick, sql
from warden.plans.path_queries import file_calls, rule_ladder
from warden.plans.registry import load, query

C = sql(CALLS)
CATALOG_SQL = "(values " + ", ".join(f"('{r[0]}', '{r[1]}', '{rules.REMEDIATION[r[3]]}')" for r in rules.CATALOG) + ") t(rule_id, effect, remediation)"

# One policy document per supplier, as the text a policy file holds.
POLICIES = """
select cast(s_suppkey as string) as project, s_suppkey,
 '{{"schema":3,"paths":{{"deny_read":["**/n' || cast(s_nationkey as string) || '/**","' ||
 case when s_suppkey % 10 = 3 then '/absolute' else 'ok/*.txt' end || '"]}},"audit_only_rules":["r.' || cast(s_suppkey as string) || '"' ||
 case when s_suppkey % 25 = 0 then ',"missing"' else '' end || '],"rules":[{{"id":"r.' || cast(s_suppkey as string) ||
 '","description":"' || case when s_suppkey % 7 = 0 then '' else 'Supplier rule' end || '","effect":"' ||
 case when s_suppkey % 2 = 0 then 'deny' else 'ask' end || '","severity":"high","match":{{"paths":["**/x' || cast(s_suppkey as string) ||
 '/**"' || case when s_suppkey % 11 = 0 then ',"a/../b"' else '' end || ']}}}},{{"id":"' ||
 case when s_suppkey % 13 = 0 then 'r.' || cast(s_suppkey as string) else 'Second.' || cast(s_suppkey as string) end ||
 '","description":"d","effect":"deny","severity":"low","category":"own","match":{{"capabilities":["file_read"],"paths":[' ||
 case when s_suppkey % 17 = 0 then '' else '"**/y"' end || ']}}}}]}}' as document from {supplier}"""


def policies(spark, folder, layer="organization"):
    parsed = derive(spark, folder, POLICIES).withColumn("p", F.from_json("document", rules.POLICY_SCHEMA))
    return parsed.select(F.lit(layer).alias("layer"), "project", "p.*")


@query("s7_load_rules", """
select cast(s_suppkey as varchar) as project, ord, rule_id, pat_ord, pattern from (
 select s_suppkey, -2 as ord, 'organization.path.deny_read' as rule_id, 0 as pat_ord, '**/n' || s_nationkey || '/**' as pattern from supplier
 union all select s_suppkey, -2, 'organization.path.deny_read', 1, case when s_suppkey % 10 = 3 then '/absolute' else 'ok/*.txt' end from supplier
 union all select s_suppkey, 0, 'r.' || s_suppkey, 0, '**/x' || s_suppkey || '/**' from supplier
 union all select s_suppkey, 0, 'r.' || s_suppkey, 1, 'a/../b' from supplier where s_suppkey % 11 = 0
 union all select s_suppkey, 1, case when s_suppkey % 13 = 0 then 'r.' else 'Second.' end || s_suppkey, 0, '**/y' from supplier where s_suppkey % 17 <> 0)""")
def s7(spark, folder):
    return rules.policy_rules(policies(spark, folder)).where("pattern is not null").select("project", "ord", "rule_id", "pat_ord", "pattern")


@query("s8_rule_quality", """
select cast(s_suppkey as varchar) as project, problem, rule_id from (
 select s_suppkey, 'pattern' as problem, 'project.path.deny_read' as rule_id from supplier where s_suppkey % 10 = 3
 union all select s_suppkey, 'pattern', 'r.' || s_suppkey from supplier where s_suppkey % 11 = 0
 union all select s_suppkey, 'description', 'r.' || s_suppkey from supplier where s_suppkey % 7 = 0
 union all select s_suppkey, 'project weakens', 'r.' || s_suppkey from supplier where s_suppkey % 2 = 1
 union all select s_suppkey, 'project candidate', 'r.' || s_suppkey from supplier
 union all select s_suppkey, 'rule id', 'Second.' || s_suppkey from supplier where s_suppkey % 13 <> 0
 union all select s_suppkey, 'no patterns', case when s_suppkey % 13 = 0 then 'r.' else 'Second.' end || s_suppkey from supplier where s_suppkey % 17 = 0
 union all select s_suppkey, 'duplicate id', 'r.' || s_suppkey from supplier where s_suppkey % 13 = 0
 union all select s_suppkey, 'unknown candidate', 'missing' from supplier where s_suppkey % 25 = 0)""")
def s8(spark, folder):
    documents = policies(spark, folder, "project")
    found = rules.rule_quality(rules.policy_rules(documents), rules.catalog(spark))
    missing = rules.unknown_candidates(documents).select(
        "layer", "project", "rule_id", F.lit("unknown candidate").alias("problem"))
    return found.unionByName(missing).select("project", "problem", "rule_id")


def decided(spark, folder):
    return replay.decide(file_calls(spark, folder).drop("project"))


@query("s13_rule_catalog", f"""
with d as (select {rule_ladder('normal_path')} as rule_id from ({C})), n as (select rule_id, count(*) as n_calls from d group by 1)
select t.rule_id, t.effect, coalesce(n_calls, 0) as n_calls from {CATALOG_SQL} left join n using (rule_id)""")
def s13(spark, folder):
    used = decided(spark, folder).groupBy("rule_id").agg(F.count("*").alias("n_calls"))
    return rules.catalog(spark).join(used, "rule_id", "left").select(
        "rule_id", "effect", F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


@query("j13_explained_decisions", f"""
with d as (select call_id, {rule_ladder('normal_path')} as rule_id from ({C}))
select call_id, d.rule_id, remediation from d left join {CATALOG_SQL} on t.rule_id = d.rule_id where d.rule_id <> 'default.no_matching_rule'""")
def j13(spark, folder):
    return audit.explained(decided(spark, folder).where("effect <> 'allow'").select("call_id", "rule_id"), rules.catalog(spark))


@query("j13_undocumented_rules", f"""
select 'default.no_matching_rule' as rule_id, count(*) as n from ({C}) where {rule_ladder('normal_path')} = 'default.no_matching_rule'""")
def j13_undocumented(spark, folder):
    return audit.undocumented(decided(spark, folder).select("rule_id"), rules.catalog(spark))


@query("j14_capability_coverage", f"""
with c as ({C}), u as (select agent, capability, count(*) as n_calls from c group by all)
select agent, capability, n_calls, cast(capability in ('shell_execute','file_read','file_write','mcp_call','unknown') as int) as covered,
  coalesce(case when capability in ('shell_execute','file_read','file_write','mcp_call','unknown')
   then case agent when 'codex' then '0.160.0' when 'cursor' then 'unverified' else '2.0.22' end end, '-') as version from u""")
def j14(spark, folder):
    return audit.coverage(calls(spark, folder), rules.capability_matrix(spark)).select(
        "agent", "capability", "n_calls", F.col("schema").isNotNull().cast("int").alias("covered"),
        F.coalesce("minimum_tested_version", F.lit("-")).alias("version"))


RECORDS = f"""
select call_id, agent, capability, rule_id, case when rule_id = 'default.no_matching_rule' then 'allow' else 'deny' end as decision,
  case when rule_id = 'default.no_matching_rule' then 'info' when rule_id like '%secret%' then 'critical' else 'high' end as severity,
  cast(cast(ts as date) as varchar) as day from (select *, {rule_ladder('normal_path')} as rule_id from ({C}))"""


def records(spark, folder):
    return decided(spark, folder).select(
        "call_id", "agent", "capability", "rule_id", F.col("effect").alias("decision"), "severity",
        F.to_date("ts").cast("string").alias("day"))


CUBE = ["agent", "capability", "rule_id", "decision"]


@query("a16_audit_summary", f"""
select {', '.join(f"coalesce({c}, '*') as {c}" for c in CUBE)}, count(*) as n, cast(grouping({', '.join(CUBE)}) as bigint) as level
from ({RECORDS}) group by cube({', '.join(CUBE)})""")
def a16(spark, folder):
    out = audit.summary(records(spark, folder), CUBE)
    return out.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in CUBE], "n", "level")


@query("a16_daily_summary", f"select day, decision, severity, count(*) as n from ({RECORDS}) group by all")
def a16_daily(spark, folder):
    return records(spark, folder).groupBy("day", "decision", "severity").agg(F.count("*").alias("n"))


@query("a15_false_positive_rate", f"""
select rule_id, count(*) as n_reviewed, cast(count_if(quality = 0) as bigint) as n_erroneous, count_if(quality = 0) / count(*) as rate
from ({RECORDS}) join labels on doc_id = call_id where decision = 'deny' group by rule_id""")
def a15(spark, folder):
    reviews = load(spark, folder, "labels").select(F.col("doc_id").alias("call_id"), (F.col("quality") == 0).alias("erroneous"))
    return audit.false_positive_rate(records(spark, folder), reviews)


SAMPLES = "select event_type as workload, cast(round(value * 1000) as bigint) as ns, cast(ts as date) as day from {events}"
RANKED = "(list(ns order by ns))[cast(ceil(count(*) * {p} / 100.0) as bigint)]"
SUMMARY = f"select workload, count(*) as samples, min(ns) as min_ns, max(ns) as max_ns, " + ", ".join(
    f"{RANKED.format(p=p)} as p{p}_ns" for p in (50, 95, 99)) + " from ({}) group by workload"


@query("a17_latency_summary", SUMMARY.format(sql(SAMPLES)))
def a17(spark, folder):
    return audit.latency(derive(spark, folder, SAMPLES))


@query("a18_latency_regressions", f"""
with s as ({sql(SAMPLES)}), h as (select median(epoch(day)) as m from s),
b as ({SUMMARY.format("select workload || cast(day(day) % 5 as varchar) as workload, ns from s where epoch(day) <= (select m from h)")}),
c as ({SUMMARY.format("select workload || cast(day(day) % 5 as varchar) as workload, ns * 5 // 4 as ns from s where epoch(day) > (select m from h)")})
select c.workload from c join b using (workload) where c.p50_ns > b.p50_ns * 1.2 or c.p95_ns > b.p95_ns * 1.2""")
def a18(spark, folder):
    samples = derive(spark, folder, SAMPLES).withColumn("at", F.unix_date("day"))
    middle = samples.agg(F.median("at").alias("m"))
    halves = samples.withColumn("k", F.lit(1)).join(F.broadcast(middle.withColumn("k", F.lit(1))), "k").withColumn(
        "workload", F.concat("workload", (F.dayofmonth("day") % 5).cast("string")))
    base = audit.latency(halves.where("at <= m").select("workload", "ns"))
    now = audit.latency(halves.where("at > m").select("workload", F.expr("ns * 5 div 4").alias("ns")))
    return audit.regressions(now, base).select("workload")


__all__ = ["pick"]
