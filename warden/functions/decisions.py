"""Decisions as structs, and the path rules evaluated inside a row."""

from __future__ import annotations

from dataclasses import dataclass

from warden.functions import sql as F
from warden.functions.globs import compile_path, match_regex
from warden.functions.paths import covers, is_absolute
from warden.functions.sql import Sql
from warden.vocab import (
    BUILT_IN_RULES, EFFECT_RANK, OPEN_CAPABILITIES, READ_CAPABILITIES, WRITE_CAPABILITIES,
)

DECISION = (
    "struct<effect:string,rule_id:string,severity:string,category:string,policy_layer:string,"
    "reason:string,matched_path:string>"
)


def decision(effect: str, rule_id: str | Sql, severity: str, category: str, layer: str = "built_in",
             reason: str = "", path: Sql | None = None) -> Sql:
    return F.struct(
        F.lit(effect).alias("effect"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"),
        F.lit(category).alias("category"), F.lit(layer).alias("policy_layer"), F.lit(reason).alias("reason"),
        (F.lit(None).cast("string") if path is None else path).alias("matched_path"),
    )


def none() -> Sql:
    return F.lit(None).cast(DECISION)


def rank(effect: Sql) -> Sql:
    """allow 0, ask 1, deny 2."""
    return F.when(effect == "allow", 0).when(effect == "ask", 1).when(effect == "deny", 2)


@dataclass(frozen=True)
class PathRule:
    """One rule of one layer with its patterns in document order."""

    layer: str
    rule_id: str
    effect: str
    severity: str
    category: str
    reason: str
    operation: str  # read, write or match
    patterns: tuple[str, ...]
    capabilities: tuple[str, ...] = ()
    project: str | None = None
    candidate: bool = False
    ord: int = 0

    def regex(self) -> str:
        return match_regex([compile_path(p).body for p in self.patterns])

    def decide(self, path: Sql | None) -> Sql:
        return decision(self.effect, self.rule_id, self.severity, self.category, self.layer, self.reason, path)


BUILT_IN = tuple(
    PathRule("built_in", id_, "deny", severity, category, reason, operation, patterns, ord=place)
    for place, (id_, category, reason, severity, operation, patterns) in enumerate(BUILT_IN_RULES)
)
# A generated ladder of this many patterns stays a reasonable expression; larger sets are joined.
MAX_INLINE = 600


@dataclass(frozen=True)
class RuleSet:
    """All rules of a replay, split by layer; small enough to be part of the plan."""

    rules: tuple[PathRule, ...] = BUILT_IN
    tables: tuple[str, ...] = ()
    unknown_tool: str = "allow"

    def of(self, layer: str, *operations: str) -> list[PathRule]:
        return [r for r in self.rules if r.layer == layer and r.operation in operations]

    def without_candidates(self) -> RuleSet:
        return RuleSet(tuple(r for r in self.rules if not r.candidate), self.tables, self.unknown_tool)

    def check_inline(self) -> RuleSet:
        size = sum(len(r.patterns) for r in self.rules)
        if size > MAX_INLINE:
            raise ValueError(f"{size} patterns are too many for one expression; use replay.decide_by_table")
        return self


def _in_project(rule: PathRule, project: Sql | None) -> Sql:
    if rule.project is None:
        return F.lit(True)
    return F.lit(False) if project is None else F.coalesce(project == rule.project, F.lit(False))


def first_match(rule: PathRule, paths: Sql) -> Sql:
    """The path of the first pattern that matches any path (A3)."""
    if len(rule.patterns) == 1:
        return F.get(F.filter(paths, lambda p: p.rlike(rule.regex())), 0)
    return F.coalesce(*[_pattern_match(paths, pattern) for pattern in rule.patterns])


def _pattern_match(paths: Sql, pattern: str) -> Sql:
    regex = compile_path(pattern).regex
    return F.get(F.filter(paths, lambda p: p.rlike(regex)), 0)


def applies(operation: str, capability: Sql, is_mcp: Sql) -> Sql:
    kinds = READ_CAPABILITIES if operation == "read" else WRITE_CAPABILITIES
    return is_mcp | capability.isin(*kinds, *OPEN_CAPABILITIES)


def first_rule(rules: list[PathRule], paths: Sql, capability: Sql, is_mcp: Sql, project: Sql | None = None) -> Sql:
    """Decision of the first rule, in the given order, that fits the call and matches a path."""
    if not rules:
        return none()
    ladder = None
    for rule in rules:
        if rule.operation == "match":
            fits = capability.isin(*rule.capabilities) if rule.capabilities else F.lit(True)
        else:
            fits = applies(rule.operation, capability, is_mcp)
        regex = rule.regex()
        test = fits & _in_project(rule, project) & F.exists(paths, lambda p: p.rlike(regex))
        value = rule.decide(first_match(rule, paths))
        ladder = F.when(test, value) if ladder is None else ladder.when(test, value)
    any_regex = match_regex([compile_path(p).body for r in rules for p in r.patterns])
    return F.when(F.exists(paths, lambda p: p.rlike(any_regex)), ladder).otherwise(none())


def strongest_first(rules: list[PathRule]) -> list[PathRule]:
    """A1: strongest effect first, document order among equals; the first match then wins."""
    return sorted(rules, key=lambda r: (-EFFECT_RANK[r.effect], r.ord))


def path_decision(path: Sql, operation: str, rules: RuleSet, project: Sql | None = None) -> Sql:
    """Decision on one normalised operand: built-in, then organization, then project."""
    ordered = [r for layer in ("built_in", "organization", "project") for r in rules.of(layer, operation)]
    if not ordered:
        return none()
    ladder = None
    for rule in ordered:
        test = path.rlike(rule.regex()) & _in_project(rule, project)
        ladder = F.when(test, rule.decide(path)) if ladder is None else ladder.when(test, rule.decide(path))
    any_regex = match_regex([compile_path(p).body for r in ordered for p in r.patterns])
    return F.when(path.rlike(any_regex), ladder).otherwise(none())


def first_rule_id(path: Sql, rules: list[PathRule], project: Sql | None = None) -> Sql:
    """Id of the first rule that matches a path, without the rest of its decision."""
    ladder = None
    for rule in rules:
        test = path.rlike(rule.regex())
        if rule.project is not None:
            test = test & _in_project(rule, project)
        ladder = F.when(test, rule.rule_id) if ladder is None else ladder.when(test, rule.rule_id)
    any_regex = match_regex([compile_path(p).body for r in rules for p in r.patterns])
    return F.when(path.rlike(any_regex), ladder)


def tree_decision(path: Sql, raw: Sql, rules: RuleSet, project: Sql | None = None) -> Sql:
    """A delete or move of a directory that holds protected descendants."""
    ladder = None
    for layer in ("built_in", "organization", "project"):
        for rule in rules.of(layer, "write"):
            for pattern in rule.patterns:
                glob = compile_path(pattern)
                test = covers(path, list(glob.prefix), path.rlike(glob.regex)) & _in_project(rule, project)
                ladder = F.when(test, rule.decide(path)) if ladder is None else ladder.when(test, rule.decide(path))
    return ladder.when(
        (raw == ".") | (path == "/"), decision("deny", "filesystem.write.ancestor", "high", "shell")
    ).otherwise(none())


def operand_decision(path: Sql, raw: Sql, operation: str, container: Sql, uncertain: Sql, rules: RuleSet,
                     project: Sql | None = None) -> Sql:
    """P24 and J4 on one operand of a command."""
    contrib = F.lit(False)
    if operation == "write":
        contrib = container & path.rlike(r"/(?:modules|themes)/contrib(?:/|\z)")
    return (
        F.when(path.isNull(), decision("deny", "guard.evaluation_error", "critical", "guard"))
        .when(contrib, decision("deny", "filesystem.write.contrib", "high", "shell"))
        .otherwise(F.coalesce(
            path_decision(path, operation, rules, project),
            F.when(uncertain & ~is_absolute(raw), decision("deny", "ddev.context.unknown", "high", "shell")),
        ))
    )
