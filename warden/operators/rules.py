"""Policies as tables: loading, quality checks, the rule catalog and the capability matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden.functions.decisions import BUILT_IN, PathRule, RuleSet
from warden.functions.globs import glob_to_regex  # noqa: F401  (public name)
from warden.vocab import MAX_PATTERNS, MAX_RULES

POLICY_SCHEMA = """
schema int, audit_only_rules array<string>, defaults struct<unknown_tool:string>,
paths struct<deny_read:array<string>,deny_write:array<string>>, sql struct<sensitive_tables:array<string>>,
result struct<secret_prefixes:array<string>,sensitive_fields:map<string,string>,ip_addresses_are_personal:boolean>,
rules array<struct<id:string,description:string,effect:string,severity:string,category:string,
`match`:struct<capabilities:array<string>,paths:array<string>>>>"""

# --- fixed values: the rule catalog (rule, effect, severity, category) -------
CATALOG = (
    ("guard.evaluation_error", "deny", "critical", "guard"),
    ("exfiltration.tainted_session", "deny", "critical", "exfiltration"),
    ("exfiltration.tainted_session.review", "ask", "high", "exfiltration"),
    ("organization.path.deny_read", "deny", "high", "filesystem"),
    ("organization.path.deny_write", "deny", "high", "filesystem"),
    ("project.path.deny_read", "deny", "high", "filesystem"),
    ("project.path.deny_write", "deny", "high", "filesystem"),
    ("drupal.secret.env", "deny", "critical", "secrets"),
    ("composer.secret.auth_json", "deny", "critical", "secrets"),
    ("drupal.secret.settings_php", "deny", "critical", "secrets"),
    ("filesystem.secret.private_key", "deny", "critical", "secrets"),
    ("filesystem.secret.credential_store", "deny", "critical", "secrets"),
    ("filesystem.write.core", "deny", "high", "filesystem"),
    ("filesystem.write.vendor", "deny", "high", "filesystem"),
    ("filesystem.write.contrib_module", "deny", "high", "filesystem"),
    ("filesystem.write.contrib_theme", "deny", "high", "filesystem"),
    ("shell.nesting_limit", "deny", "high", "shell"),
    ("shell.ambiguous", "deny", "high", "shell"),
    ("shell.privilege_escalation", "deny", "critical", "shell"),
    ("shell.language_eval", "deny", "high", "shell"),
    ("shell.drush.eval", "deny", "critical", "drush"),
    ("shell.drush.sql_dump", "deny", "high", "drush"),
    ("shell.drush.sql_cli", "deny", "high", "drush"),
    ("drush.mutation.review", "ask", "medium", "drush"),
    ("ddev.shell_escape", "deny", "high", "ddev"),
    ("ddev.database_transfer", "deny", "high", "ddev"),
    ("ddev.sql.interactive", "deny", "high", "sql"),
    ("sql.ambiguous", "deny", "high", "sql"),
    ("sql.read.sensitive_table", "deny", "high", "sql"),
    ("sql.mutation.insert", "deny", "critical", "sql"),
    ("sql.mutation.update", "deny", "critical", "sql"),
    ("sql.mutation.delete", "deny", "critical", "sql"),
    ("sql.mutation.drop", "deny", "critical", "sql"),
    ("sql.mutation.alter", "deny", "critical", "sql"),
    ("sql.mutation.truncate", "deny", "critical", "sql"),
    ("sql.mutation.replace", "deny", "critical", "sql"),
    ("sql.mutation.create", "deny", "critical", "sql"),
    ("sql.mutation.grant", "deny", "critical", "sql"),
    ("sql.mutation.revoke", "deny", "critical", "sql"),
    ("ddev.shell_semantics", "deny", "high", "ddev"),
    ("ddev.context.unknown", "deny", "high", "ddev"),
    ("git.force_push", "deny", "high", "git"),
    ("git.credential_config", "deny", "high", "git"),
    ("git.write.review", "ask", "medium", "git"),
    ("composer.dependencies.modify", "ask", "medium", "composer"),
    ("composer.scripts.execute", "ask", "high", "composer"),
)
# What to do instead, in our own words, per group of rules.
REMEDIATION = {
    "guard": "Check the installation and the request; never bypass the check.",
    "exfiltration": "Start a clean session, or let a person hand over an approved value.",
    "filesystem": "Use a path the policy allows, or the managed update workflow.",
    "secrets": "Ask for the one derived value that is needed; keep the secret out of the session.",
    "shell": "Run one plain command that can be read as it is.",
    "drush": "Use a specific read-only command, or ask for a review.",
    "ddev": "Run the command directly, in the web service, with an absolute directory.",
    "sql": "Use one explicit read-only statement on tables that hold no sensitive data.",
    "git": "Let a developer review or perform the change of the repository.",
    "composer": "Ask for approval with the intended change.",
}
# --- fixed values: support matrix (agent, capability, version, guarded execution, proxy)
MATRIX = tuple(
    (agent, kind, version, kind == "shell_execute", kind == "mcp_call")
    for agent, version, kinds in (
        ("codex", "0.160.0", ("shell_execute", "file_read", "file_write", "mcp_call", "unknown")),
        ("cursor", "unverified", ("shell_execute", "file_read", "file_write", "mcp_call", "unknown")),
        ("opencode", "2.0.22", ("shell_execute", "file_read", "file_write", "network_read", "mcp_call", "unknown")),
    ) for kind in kinds
)


def catalog(spark: SparkSession) -> DataFrame:
    """The documented rules."""
    rows = [(*row, REMEDIATION[row[3]]) for row in CATALOG]
    return spark.createDataFrame(rows, "rule_id string, effect string, severity string, category string, remediation string")


def capability_matrix(spark: SparkSession) -> DataFrame:
    """What is supported for each agent and capability."""
    rows = [(3, a, k, "observe_only", True, False, False, True, False, g, p, False, "pre_call_deny_and_post_observe", v)
            for a, k, v, g, p in MATRIX]
    return spark.createDataFrame(rows, (
        "schema int, agent string, tool_category string, interception string, pre_call_denial boolean, "
        "host_fail_closed_verified boolean, input_rewrite boolean, result_observation boolean, "
        "pre_context_output_replacement boolean, guarded_execution_support boolean, mcp_proxy_support boolean, "
        "pre_context_containment boolean, security_mode string, minimum_tested_version string"))


RULE_COLUMNS = ("layer", "project", "ord", "rule_id", "effect", "severity", "category", "reason", "operation",
                "capabilities", "candidate", "pat_ord", "pattern")


def as_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """A rule set as rows, one per pattern."""
    rows = [(r.layer, r.project, r.ord, r.rule_id, r.effect, r.severity, r.category, r.reason, r.operation,
             list(r.capabilities), r.candidate, i, p) for r in rules.rules for i, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, (
        "layer string, project string, ord int, rule_id string, effect string, severity string, category string, "
        "reason string, operation string, capabilities array<string>, candidate boolean, pat_ord int, pattern string"))


def built_in_rules(spark: SparkSession) -> DataFrame:
    return as_table(spark, RuleSet(BUILT_IN))


def policy_rules(policies: DataFrame) -> DataFrame:
    """Parsed policies (columns layer, project and the policy document) as one row per pattern, in document order."""
    def paths(operation: str, place: int) -> DataFrame:
        return policies.select(
            "layer", "project", F.lit(place).alias("ord"),
            F.concat("layer", F.lit(f".path.deny_{operation}")).alias("rule_id"), F.lit("deny").alias("effect"),
            F.lit("high").alias("severity"), F.lit("filesystem").alias("category"), F.lit("").alias("reason"),
            F.lit(operation).alias("operation"), F.expr("cast(array() as array<string>)").alias("capabilities"),
            F.lit(False).alias("candidate"), F.posexplode(f"paths.deny_{operation}").alias("pat_ord", "pattern"))

    own = policies.select("layer", "project", F.coalesce("audit_only_rules", F.expr("cast(array() as array<string>)")).alias("held"),
                          F.posexplode("rules").alias("ord", "r"))
    custom = own.select(
        "layer", "project", "ord", F.col("r.id").alias("rule_id"), "r.effect", "r.severity",
        F.coalesce("r.category", F.lit("policy")).alias("category"), F.col("r.description").alias("reason"),
        F.lit("match").alias("operation"),
        F.coalesce("r.match.capabilities", F.expr("cast(array() as array<string>)")).alias("capabilities"),
        F.array_contains("held", F.col("r.id")).alias("candidate"),
        F.posexplode_outer("r.match.paths").alias("pat_ord", "pattern"))
    return paths("read", -2).unionByName(paths("write", -1)).unionByName(custom)


def unknown_candidates(policies: DataFrame) -> DataFrame:
    """Candidate ids that name no rule of their own policy."""
    held = policies.select("layer", "project", F.explode("audit_only_rules").alias("rule_id"))
    own = policies.select("layer", "project", F.explode("rules.id").alias("rule_id"))
    same = (held.layer == own.layer) & held.project.eqNullSafe(own.project) & (held.rule_id == own.rule_id)
    return held.join(own, same, "left_anti")


def load_rules(spark: SparkSession, organization: str | None = None, projects: str | None = None) -> DataFrame:
    """Built-in rules and policy documents. Project files lie in folders named project=KEY."""
    rules = built_in_rules(spark)
    for layer, path in (("organization", organization), ("project", projects)):
        if path is None:
            continue
        parsed = spark.read.option("multiLine", True).schema(
            POLICY_SCHEMA + (", project string" if layer == "project" else "")).json(path)
        parsed = parsed if layer == "project" else parsed.withColumn("project", F.lit(None).cast("string"))
        rules = rules.unionByName(policy_rules(parsed.withColumn("layer", F.lit(layer))))
    return rules


def rule_set(rules: DataFrame, tables: tuple[str, ...] = (), unknown_tool: str = "allow") -> RuleSet:
    """Rule rows as a set that can be part of a plan; the number of rows is checked, not assumed."""
    bound = MAX_RULES * MAX_PATTERNS
    rows = rules.where("pattern is not null").select(*RULE_COLUMNS).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("a policy holds at most 1,024 rules of 256 patterns")
    grouped: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r.layer, r.project or "", r.ord, r.pat_ord)):
        grouped.setdefault((r.layer, r.project, r.ord, r.rule_id), []).append(r)
    made = [
        PathRule(first.layer, first.rule_id, first.effect, first.severity, first.category, first.reason, first.operation,
                 tuple(r.pattern for r in group), tuple(first.capabilities), first.project, first.candidate, first.ord)
        for group in grouped.values() for first in group[:1]]
    return RuleSet(tuple(made), tables, unknown_tool)


def rule_quality(rules: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """One row per defect of a rule table (one row per pattern, see policy_rules)."""
    bad_pattern = (
        (F.col("pattern") == "") | F.col("pattern").startswith("/") | F.col("pattern").rlike(r"(?:^|/)\.\.(?:/|$)")
        | F.contains("pattern", F.lit("\0")))
    custom = F.col("operation") == "match"
    problems = F.filter(F.array(
        F.when(custom & ~F.col("rule_id").rlike(r"^[a-z0-9._-]{1,128}\z"), "rule id"),
        F.when(custom & ~F.octet_length("reason").between(1, 512), "description"),
        F.when(custom & ~F.octet_length("category").between(1, 64), "category"),
        F.when(bad_pattern, "pattern"),
        F.when(custom & F.col("pattern").isNull(), "no patterns"),
        F.when((F.col("layer") == "project") & (F.col("effect") != "deny"), "project weakens"),
        F.when((F.col("layer") == "project") & F.col("candidate"), "project candidate"),
        F.when(F.col("candidate") & (F.col("effect") == "allow"), "candidate allows"),
    ), lambda p: p.isNotNull())
    own = rules.select("layer", "project", "rule_id", F.explode_outer(problems).alias("problem")).where("problem is not null")
    per_rule = rules.where(custom).groupBy("layer", "project", "rule_id", "ord").agg(F.count("*").alias("n_patterns"))
    crowded = per_rule.where(F.col("n_patterns") > MAX_PATTERNS).select("layer", "project", "rule_id", F.lit("too many patterns").alias("problem"))
    repeated = per_rule.groupBy("layer", "project", "rule_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "layer", "project", "rule_id", F.lit("duplicate id").alias("problem"))
    found = own.unionByName(crowded).unionByName(repeated)
    if documented is not None:
        held = rules.where("candidate").select("layer", "project", "rule_id").distinct().join(
            F.broadcast(documented.select("rule_id")), "rule_id", "left_semi")
        found = found.unionByName(held.select("layer", "project", "rule_id", F.lit("candidate is registered").alias("problem")))
    return found.distinct()
