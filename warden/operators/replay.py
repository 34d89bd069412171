"""Policy replay: decide every call of a log, compare two policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.calls import is_mcp
from warden.functions.decisions import (
    DECISION, RuleSet, applies, decision, first_rule, none, rank, strongest_first, tree_decision,
)
from warden.functions.paths import basename, normalize
from warden.functions.sql import Sql
from warden.operators import paths as path_ops


BULK = decision("deny", "filesystem.read.bulk", "high", "shell")
#: What a rule table says about the paths of a call: as a tree that is removed, then by layer.
MATCHED = ("_by_tree", "_by_built_in", "_by_organization", "_by_project")


def _bulk(paths: Sql, capability: Sql) -> Sql:
    return (capability == "file_search") & (
        (S.size(paths) == 0) | S.exists(paths, lambda p: ~S.contains(basename(p), ".")))


def _policy(layer: str, paths: Sql, capability: Sql, mcp: Sql, rules: RuleSet, project: Sql | None) -> Sql:
    """deny_read, then deny_write, then the strongest custom rule of one policy."""
    ordered = rules.of(layer, "read") + rules.of(layer, "write") + strongest_first(rules.of(layer, "match"))
    return first_rule(ordered, paths, capability, mcp, project)


def with_decision(calls: DataFrame, rules: RuleSet, column: str, command: str | None = None,
                  matched: bool = False) -> DataFrame:
    """Adds the decision of a call as a struct, in the truth order of the policy contract; see ``decide``.

    ``matched`` says that the columns of MATCHED hold what the rules say about the call's paths already.
    """
    rules.check_inline()
    project = S.ref("project") if "project" in calls.columns else None
    places = {n: f"{column}{n}" for n in ("_command", "_paths", "_early", "_org", "_project")}
    calls = calls.withColumn(places["_command"], F.lit(None).cast(DECISION) if command is None else F.col(command))
    cwd, capability = S.ref("cwd"), S.ref("capability")
    mcp = is_mcp(S.ref("tool_name"), capability)
    calls = calls.withColumn(places["_paths"], S.col(
        S.coalesce(S.transform(S.ref("paths"), lambda p: normalize(cwd, p)), S.expr("cast(array() as array<string>)"))))
    cmd, paths, early, org, own = (S.ref(c) for c in places.values())
    broken = S.exists(paths, lambda p: p.isNull())
    by_tree, by_built_in, by_org, by_own = (S.ref(c) for c in MATCHED)
    tree = by_tree if matched else S.when(
        capability.isin("file_delete", "file_move"),
        S.get(S.filter(S.transform(paths, lambda p: tree_decision(p, p, rules, project)),
                       lambda d: d.isNotNull()), 0),
    )
    staged = calls.withColumn(places["_early"], S.col(
        S.when(cmd["effect"] == "deny", cmd)
        .when(broken, decision("deny", "guard.evaluation_error", "critical", "guard"))
        .otherwise(S.coalesce(tree, S.when(_bulk(paths, capability), BULK).otherwise(
            by_built_in if matched else first_rule(rules.of("built_in", "read", "write"), paths, capability, mcp))))))
    open_ = early.isNull()
    staged = staged.withColumn(places["_org"], S.col(S.when(
        open_, by_org if matched else _policy("organization", paths, capability, mcp, rules, None))))
    staged = staged.withColumn(places["_project"], S.col(S.when(
        open_, by_own if matched else _policy("project", paths, capability, mcp, rules, project))))
    org_or_command = S.when(
        org.isNotNull() & cmd.isNotNull() & (rank(org["effect"]) < rank(cmd["effect"])), cmd).otherwise(org)
    default_effect = S.when(capability == "unknown", rules.unknown_tool).otherwise("allow")
    default = S.struct(
        default_effect.alias("effect"), S.lit("default.no_matching_rule").alias("rule_id"),
        S.lit("info").alias("severity"), S.lit("default").alias("category"),
        S.lit("default").alias("policy_layer"), S.lit("").alias("reason"),
        S.lit(None).cast("string").alias("matched_path")).cast(DECISION)
    final = S.let_as(DECISION, org_or_command, lambda above: S.when(
        early.isNotNull(), early)
        .when(above.isNotNull() & own.isNotNull(),
              S.when(rank(own["effect"]) > rank(above["effect"]), own).otherwise(above))
        .when(above.isNotNull(), above)
        .when(own.isNotNull(), own)
        .when(cmd.isNotNull() & (rank(cmd["effect"]) >= rank(default_effect)), cmd)
        .otherwise(default))
    return staged.withColumn(column, S.col(final)).drop(*places.values())


def decide(calls: DataFrame, rules: RuleSet = RuleSet(), command: DataFrame | str | None = None,
           omit_candidates: bool = False) -> DataFrame:
    """One decision per call, in the truth order of the policy contract.

    ``calls`` has call_id, cwd, tool_name, capability and paths (array); a column
    ``project`` selects project rules. ``command`` is the decision of a call's commands
    and queries: the name of a column that holds it (commands.with_call_decision), and the
    whole replay is one projection, or a frame (call_id, decision), which costs a join.
    """
    rules = rules.without_candidates() if omit_candidates else rules
    if command is not None and not isinstance(command, str):
        calls = calls.join(command.select("call_id", F.col("decision").alias("_by_command")), "call_id", "left")
        command = "_by_command"
    done = with_decision(calls, rules, "_decision", command).drop("_by_command")
    # As a generated row the decision is computed once; a later filter on it cannot
    # copy the whole ladder into the scan.
    return done.select(*[c for c in done.columns if c != "_decision"], F.inline_outer(F.array("_decision")))


def _table_hits(places: DataFrame, rules: DataFrame, match) -> DataFrame:
    """Matches of the paths of calls with the rules for all projects and with those of the call's own."""
    rules = rules.withColumnRenamed("project", "of")
    hits = match(places, rules.where("layer <> 'project'"), ())
    if "project" in places.columns:
        own = rules.where("layer = 'project'").withColumnRenamed("of", "project")
        hits = hits.unionByName(match(places, own, ("project",)).withColumn("of", F.col("project")), True)
    return hits


def match_table(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """J1-J3, J5, A1, A3 for a rule table of any size: adds the columns of MATCHED to ``calls``.

    ``rules`` has the columns of rules.RULE_COLUMNS, a row per pattern. Paths meet patterns by their rarest literal part
    (operators.paths); of a call's matches one aggregation keeps the first of each layer.
    """
    columns = [c for c in ("call_id", "project", "capability", "tool_name") if c in calls.columns]
    rules = rules.where("pattern is not null")
    places = calls.select(*columns, F.posexplode(S.col(S.transform(
        S.ref("paths"), lambda p: normalize(S.ref("cwd"), p)))).alias("path_ord", "path")).where("path is not null")
    hits = _table_hits(places, rules, path_ops.match_rules)
    operation, kind = S.ref("operation"), S.ref("capability")
    mcp = is_mcp(S.ref("tool_name"), kind)
    fits = S.when(operation == "read", applies("read", kind, mcp)).when(
        operation == "write", applies("write", kind, mcp)).otherwise(
        (S.size(S.ref("capabilities")) == 0) | S.array_contains(S.ref("capabilities"), kind))
    removing = places.where("capability in ('file_delete', 'file_move')")

    def tree(paths: DataFrame, table: DataFrame, by: tuple[str, ...]) -> DataFrame:
        met = path_ops.tree_matches(paths, table, by)
        return paths.join(met, ["path", *by]).join(table, ["pattern", *by])

    trees = _table_hits(removing, rules.where("operation = 'write'"), tree)
    both = hits.where(S.col(fits)).withColumn("tree", F.lit(False)).unionByName(trees.withColumn("tree", F.lit(True)))
    value = F.struct(*[F.col(c) for c in ("effect", "rule_id", "severity", "category")], F.col("layer").alias("policy_layer"),
                     "reason", F.col("path").alias("matched_path"))
    place = F.when(F.col("operation") == "read", 0).when(F.col("operation") == "write", 1).otherwise(2)
    strength = F.when(F.col("operation") == "match", -S.col(rank(S.ref("effect")))).otherwise(0)
    layer = F.when(F.col("layer") == "built_in", 0).when(F.col("layer") == "organization", 1).otherwise(2)
    in_layer = F.struct(F.when(F.col("layer") == "built_in", 0).otherwise(place).alias("a"), strength.alias("b"), "ord", "pat_ord",
                        "path_ord")
    first = lambda name: F.min_by(value, F.when(
        (F.col("layer") == name) & ~F.col("tree"), in_layer)).alias(f"_by_{name}")
    found = both.groupBy("call_id").agg(
        F.min_by(value, F.when(F.col("tree"), F.struct("path_ord", layer.alias("a"), "ord", "pat_ord"))).alias("_by_rule"),
        F.min(F.when(F.col("tree"), F.col("path_ord"))).alias("_by_ord"), *[first(n) for n in (
            "built_in", "organization", "project")])
    # A folder that holds everything is protected by no rule of its own.
    top = places.where("capability in ('file_delete', 'file_move')").groupBy("call_id").agg(F.min(F.when(
        (F.col("path") == "/"), F.col("path_ord"))).alias("_top"))
    raw = S.array_position(S.ref("paths"), ".").cast("int") - 1
    ancestor = S.col(decision("deny", "filesystem.write.ancestor", "high", "shell").cast(DECISION))
    out = calls.join(found, "call_id", "left").join(top, "call_id", "left").withColumn(
        "_top", F.least("_top", S.col(S.when(S.ref("capability").isin("file_delete", "file_move") & (raw >= 0), raw))))
    return out.withColumn("_by_tree", F.when(
        F.col("_by_ord").isNotNull() & (F.col("_top").isNull() | (F.col("_by_ord") <= F.col("_top"))),
        F.col("_by_rule").cast(DECISION)).when(F.col("_top").isNotNull(), ancestor)).withColumns(
        {c: F.col(c).cast(DECISION) for c in MATCHED[1:]}).drop("_by_rule", "_by_ord", "_top")


def decide_by_table(calls: DataFrame, rules: DataFrame, command: str | None = None, unknown_tool: str = "allow",
                    omit_candidates: bool = False) -> DataFrame:
    """``decide`` for a rule table of any size (a row per pattern): the same decisions, by an index join on the paths."""
    if omit_candidates:
        rules = rules.where("not candidate")
    done = with_decision(match_table(calls, rules), RuleSet((), (), unknown_tool), "_decision", command, True)
    return done.select(*calls.columns, F.inline_outer(F.array("_decision")))


def _both(calls: DataFrame, first: RuleSet, second: RuleSet, command: str | None) -> DataFrame:
    """The columns of ``calls`` and two decisions, a and b, in one projection over one scan."""
    kept = calls.columns
    done = with_decision(with_decision(calls, first, "_a", command), second, "_b", command)
    return done.select(*kept, F.inline(F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")))))


def diff(calls: DataFrame, before: RuleSet, after: RuleSet, command: str | None = None) -> DataFrame:
    """Calls whose outcome differs between two policies, each call read and decided on once."""
    both = _both(calls, before, after, command).select(
        "call_id", F.col("a.effect").alias("effect_before"), F.col("a.rule_id").alias("rule_before"),
        F.col("b.effect").alias("effect_after"), F.col("b.rule_id").alias("rule_after"))
    return both.where("effect_before <> effect_after or rule_before <> rule_after")


def candidate_decisions(calls: DataFrame, rules: RuleSet, command: str | None = None) -> DataFrame:
    """A14 input: evaluated and enforced decision of every call, in one projection."""
    both = _both(calls, rules, rules.without_candidates(), command)
    return both.select(
        *calls.columns, "a.*", F.col("b.effect").alias("enforcement_decision"),
        F.col("b.rule_id").alias("enforcement_rule_id"))


def candidate_report(decided: DataFrame, candidates: list[str]) -> DataFrame:
    """Would-deny and overlap counts of candidate rules."""
    return (
        decided.where(F.col("rule_id").isin(*candidates))
        .groupBy("rule_id")
        .agg(
            F.count("*").alias("n_evaluated"),
            F.count_if((F.col("effect") == "deny") & (F.col("enforcement_decision") == "allow")).alias("n_would_deny"),
            F.count_if(F.col("enforcement_decision") == "deny").alias("n_overlap"),
        )
    )


__all__ = ["candidate_decisions", "candidate_report", "decide", "decide_by_table", "diff", "match_table", "none", "with_decision"]
