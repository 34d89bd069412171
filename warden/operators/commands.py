"""Command-log audit: segments, operands, verdicts, sinks and sources of logged commands.

A command line becomes an array of units inside its row, nested shells and
container calls included. A decision needs no more than the row: the checks of
all units are an array, each meets the path rules there, and the strongest stays.
Reports on units and checks explode the same arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.calls import database_tool, is_mcp, tool_sink
from warden.functions.decisions import DECISION, RuleSet, decision, operand_decision, rank, tree_decision
from warden.functions.paths import normalize
from warden.functions.programs import (
    CHECK, after, args_of, check, command_args, ddev_exec, ddev_rest, fixed, literal, path_checks, read_paths,
    short_flag, sink, sql_text, verdict_check,
)
from warden.functions.shell import OPAQUE_WRAPPERS, WRAPPERS, program, segments as split_segments, strip_wrappers
from warden.functions.sql import Sql
from warden.functions.statements import query_decision
from warden.vocab import MAX_SHELL_DEPTH, MAX_SHELL_TOKENS, MAX_STRING_BYTES

# kind: text and argv are still to be opened, run is one inspectable command, writes
# are redirection targets, rule is a verdict found while opening.
_FIELDS = {
    "kind": "string", "text": "string", "argv": "array<string>", "cwd": "string", "container": "boolean",
    "uncertain": "boolean", "audible": "boolean", "rule": "string", "pos": "array<int>",
}
UNIT = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">"
_STRINGS = "cast(array() as array<string>)"
UNITS = f"array<{UNIT}>"
CHECKS = f"array<{CHECK}>"
_UNITS = f"cast(array() as {UNITS})"
# Severity and category of the rules found while opening; all others are high and shell.
_OPENING_RULES = {"guard.evaluation_error": ("critical", "guard"), "ddev.context.unknown": ("high", "ddev")}


def _unit(kind: str, pos: Sql, base: Sql, **values) -> Sql:
    """A unit; what is not given comes from ``base`` or is empty."""
    fields = {"kind": kind, "text": None, "argv": None, "rule": None, "pos": pos,
              **{n: base[n] for n in ("cwd", "container", "uncertain", "audible")}, **values}
    return S.struct(*[S.lit(fields[n]).cast(t).alias(n) for n, t in _FIELDS.items()])


def _place(pos: Sql, *at) -> Sql:
    return S.concat(pos, S.array(*at))


def _opened(argv: Sql, base: Sql, pos: Sql) -> Sql:
    """Units of one command: itself, or what its shell or container call runs."""
    def nested_shell(args: Sql) -> Sql:
        place = S.array_position(S.transform(args, lambda a: short_flag(a, "c")), True).cast("int")
        first_operand = S.array_position(S.transform(args, lambda a: ~a.startswith("-")), True).cast("int")
        inner = S.get(args, place)
        found = (place > 0) & inner.isNotNull()
        strict = found & ((first_operand == 0) | (place < first_operand))
        return S.concat(
            S.when(strict, S.expr(_UNITS)).otherwise(S.array(_unit("rule", _place(pos, 1), base, rule="shell.ambiguous"))),
            S.when(found, S.array(_unit("text", _place(pos, 2), base, text=inner, audible=base["audible"] & strict)))
            .otherwise(S.expr(_UNITS)))

    def container_call(run: Sql) -> Sql:
        here = S.struct(
            S.coalesce(run["dir"], S.lit("/var/www/html")).alias("cwd"), S.lit(True).alias("container"),
            run["dir"].isNull().alias("uncertain"), base["audible"].alias("audible"))
        inner, single = run["inner"], (S.size(run["inner"]) == 1) & ~run["raw"]
        return S.let_as(UNITS, here, lambda h: S.concat(
            S.when(run["raw"] | single | literal(inner), S.expr(_UNITS)).otherwise(
                S.array(_unit("rule", _place(pos, 1), h, rule="ddev.shell_semantics"))),
            S.array(_unit(S.when(single, "text").otherwise("argv"), _place(pos, 2), h,
                          text=S.when(single, S.get(inner, 0)), argv=inner))))

    def ddev_units(rest: Sql) -> Sql:
        command = S.get(rest, 0)
        return (
            S.when(command.isin("exec", "."), S.let_as(UNITS, ddev_exec(after(rest, 2)), lambda r: S.when(
                r.isNull(), S.array(_unit("rule", _place(pos, 2), base, rule="ddev.context.unknown"))
            ).otherwise(container_call(r))))
            .otherwise(S.array(_unit("run", _place(pos, 2), base, argv=S.when(
                command.isin("drush", "composer"), rest).otherwise(argv_of(rest))))))

    def argv_of(rest: Sql) -> Sql:
        return S.when(rest.isNull(), S.array("ddev", "--unknown")).otherwise(S.concat(S.array("ddev"), rest))

    def named(words: Sql) -> Sql:
        name = program(words)
        return (
            S.when(words.isNull(), S.array(_unit("rule", _place(pos, 3), base, rule="shell.ambiguous")))
            .when(S.size(words) == 0, S.expr(_UNITS))
            .when(name.isin("sh", "bash"), nested_shell(args_of(words)))
            .when(name == "ddev", S.let_as(UNITS, ddev_rest(args_of(words)), ddev_units))
            .otherwise(S.array(_unit("run", _place(pos, 2), base, argv=words))))

    return S.let_as(UNITS, strip_wrappers(argv), named)


def _level(unit: Sql) -> Sql:
    """Open one unit by one level: its text into segments, every segment into units."""
    pos = unit["pos"]
    as_segment = S.array(S.struct(
        unit["cwd"].alias("cwd"), unit["argv"].alias("argv"), S.expr(_STRINGS).alias("targets"),
        S.lit(False).alias("broken"), S.lit(False).alias("moves"), S.lit(False).alias("lost")))
    parts = S.when(unit["kind"] == "text", split_segments(unit["text"], unit["cwd"])).otherwise(as_segment)

    def one(s: Sql, i: Sql, lost: Sql) -> Sql:
        here = S.struct(s["cwd"].alias("cwd"), unit["container"].alias("container"),
                        unit["uncertain"].alias("uncertain"), (unit["audible"] & ~lost).alias("audible"))
        return S.let_as(UNITS, here, lambda h: S.concat(
            S.when(s["broken"], S.array(_unit("rule", _place(pos, i, 9), h, rule="guard.evaluation_error")))
            .when(S.size(s["targets"]) > 0, S.array(_unit("writes", _place(pos, i, 0), h, argv=s["targets"])))
            .otherwise(S.expr(_UNITS)),
            _opened(s["argv"], h, _place(pos, i))))

    def opened(found: Sql) -> Sql:
        # Where data may go is still read from a command whose directory is unknown.
        lost = S.exists(found, lambda s: s["lost"])
        return S.let_as(UNITS, lost, lambda gone: S.concat(
            S.when(gone, S.array(_unit("rule", _place(pos, 99), unit, rule="shell.ambiguous"))).otherwise(S.expr(_UNITS)),
            S.flatten(S.transform(S.filter(found, lambda s: ~s["moves"]), lambda s, i: one(s, i, gone)))))

    return S.when(~unit["kind"].isin("text", "argv"), S.array(unit)).otherwise(S.let_as(
        UNITS, parts, lambda found: S.when(found.isNull(), S.array(_unit("rule", pos, unit, rule="shell.ambiguous")))
        .otherwise(opened(found))))


def _too_deep(unit: Sql) -> Sql:
    return S.when(unit["kind"].isin("text", "argv"), _unit("rule", unit["pos"], unit, rule="shell.nesting_limit")
                  ).otherwise(unit)


# One plain command: words of ordinary characters with blanks between them. Its program is none of those that run others.
_PLAIN = r"""(?s)^[ \t\r]*+(?![A-Za-z0-9_]+=|cd[ \t\r]|cd\z)(?:[^ \t\r\n'"\\;&|><$`*?\[\](){}~\x00]++[ \t\r]*+)++\z"""
_OPENERS = ("sh", "bash", "ddev", *WRAPPERS, *OPAQUE_WRAPPERS)


def _start(command: Sql, i: Sql, base: Sql) -> Sql:
    """The first unit of a command line: what a plain command runs, else its text, which is still to be opened."""
    words = S.filter(S.split(command, r"[ \t\r]+"), lambda w: w != "")
    plain = command.rlike(_PLAIN) & (S.octet_length(command) <= MAX_STRING_BYTES)
    return S.when(plain, S.let_as(UNIT, words, lambda argv: S.when(
        program(argv).isin(*_OPENERS) | (S.size(argv) > MAX_SHELL_TOKENS), _unit("text", S.array(i), base, text=command))
        .otherwise(_unit("run", S.array(i, 0, 2), base, argv=argv)))).otherwise(
        _unit("text", S.array(i), base, text=command))


def units(commands: Sql, cwd: Sql) -> Sql:
    """The units of an array of command lines, as an array."""
    base = S.struct(cwd.alias("cwd"), S.lit(False).alias("container"), S.lit(False).alias("uncertain"),
                    S.lit(True).alias("audible"))
    start = S.transform(commands, lambda c, i: _start(c, i, base))
    closed = lambda found: ~S.exists(found, lambda x: x["kind"].isin("text", "argv"))
    # One level of nesting per round; a command without nested shells is done after the first.
    opened = lambda first: S.aggregate(
        S.sequence(0, MAX_SHELL_DEPTH), first,
        lambda found, _round: S.when(closed(found), found).otherwise(S.flatten(S.transform(found, _level))),
        lambda found: S.transform(found, _too_deep))
    return S.let_as(UNITS, start, lambda first: S.when(closed(first), first).otherwise(opened(first)))


def segments(calls: DataFrame) -> DataFrame:
    """One row per unit of every command; ``commands`` is the array of a call's command lines."""
    keep = [c for c in ("call_id", "project") if c in calls.columns]
    found = calls.where("size(commands) > 0").select(*keep, S.col(units(S.ref("commands"), S.ref("cwd"))).alias("_units"))
    return found.select(*keep, F.explode_outer("_units").alias("u")).where("u is not null").select(*keep, "u.*")


def _rest(name: Sql, args: Sql) -> Sql:
    """What follows global options."""
    return S.when(name == "ddev", S.when(S.get(args, 0) != "--unknown", args)).otherwise(command_args(name, args))


def _parts(rows: DataFrame) -> DataFrame:
    """Adds _name, _args and _rest (what follows global options) of the commands that run."""
    argv = S.ref("argv")
    run = rows.withColumn("_name", S.col(S.when(S.ref("kind") == "run", program(argv)))).withColumn(
        "_args", S.col(args_of(argv)))
    return run.withColumn("_rest", S.col(_rest(S.ref("_name"), S.ref("_args"))))


def protected_reads(rules: RuleSet) -> list[str]:
    return [p for layer in ("built_in", "organization", "project") for r in rules.of(layer, "read") for p in r.patterns]


def _opening_verdict(rule: Sql) -> Sql:
    severity, category = S.lit("high"), S.lit("shell")
    for known, (level, group) in _OPENING_RULES.items():
        severity = S.when(rule == known, level).otherwise(severity)
        category = S.when(rule == known, group).otherwise(category)
    return S.array(verdict_check(S.struct(
        rule.alias("rule_id"), S.lit("deny").alias("effect"), severity.alias("severity"), category.alias("category"))))


def _by_query(name: Sql, args: Sql, rest: Sql, rules: RuleSet) -> Sql:
    """Verdict on the SQL text that a command runs, for commands that can run one."""
    needs_sql = (name == "mysql") | (name == "drush") | (name == "ddev")
    return S.when(needs_sql, S.let_as(DECISION, sql_text(name, args, rest), lambda text: S.when(
        text.isNull(), decision("deny", "sql.ambiguous", "high", "sql")).otherwise(query_decision(text, rules.tables))))


def checks(unit: Sql, rules: RuleSet) -> Sql:
    """The checks of one unit as an array, in the order in which the first hit decides."""
    def run(name: Sql, args: Sql, rest: Sql) -> Sql:
        by_path = path_checks(name, args, unit["cwd"], protected_reads(rules))
        return S.let_as(CHECKS, _by_query(name, args, rest, rules), lambda q: S.let_as(CHECKS, fixed(name, args, rest, q), lambda d: S.when(
            d.isNotNull(), S.array(verdict_check(d))).otherwise(by_path)))

    return (
        S.when(unit["kind"] == "writes", S.transform(unit["argv"], lambda p: check(p, "write", False, unit["cwd"])))
        .when(unit["kind"] == "rule", _opening_verdict(unit["rule"]))
        .when(unit["kind"] == "run", S.let_as(CHECKS, program(unit["argv"]), lambda name: S.let_as(
            CHECKS, args_of(unit["argv"]), lambda args: S.let_as(CHECKS, _rest(name, args), lambda rest: run(name, args, rest)))))
        .otherwise(S.expr(f"cast(array() as array<{CHECK}>)")))


def check_decision(c: Sql, unit: Sql, rules: RuleSet, project: Sql | None) -> Sql:
    """The decision of one check, NULL if it decides nothing."""
    container, uncertain, raw = unit["container"], unit["uncertain"], c["path"]
    given = S.struct(
        c["effect"].alias("effect"), c["rule"].alias("rule_id"), c["severity"].alias("severity"),
        c["category"].alias("category"), S.lit("built_in").alias("policy_layer"), S.lit("").alias("reason"),
        S.lit(None).cast("string").alias("matched_path")).cast(DECISION)

    def by_path(path: Sql) -> Sql:
        reading = operand_decision(path, raw, "read", container, uncertain, rules, project)
        writing = operand_decision(path, raw, "write", container, uncertain, rules, project)
        tree = S.when(c["tree"], tree_decision(path, raw, rules, project))
        return S.when(c["operation"] == "read", reading).otherwise(S.coalesce(writing, tree)).cast(DECISION)

    return S.when(c["rule"].isNotNull(), given).otherwise(S.let_as(DECISION, normalize(c["cwd"], raw), by_path))


def operands(rows: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """One row per check of a unit, in the order in which the first hit decides."""
    keep = [c for c in rows.columns if c not in ("kind", "text", "argv", "rule", "audible", "cwd")]
    found = rows.where("audible").withColumn("_checks", S.col(checks(S.fields(*_FIELDS), rules)))
    return found.select(*keep, F.posexplode_outer("_checks").alias("idx", "c")).where("c is not null").select(
        *keep, "idx", "c.*")


def decided(checks_: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """The decision of every check, if it has one."""
    rules.check_inline()
    project = S.ref("project") if "project" in checks_.columns else None
    row = S.fields(*checks_.columns)
    return checks_.withColumn("decision", S.col(check_decision(row, row, rules, project)))


def strongest(rows: DataFrame) -> DataFrame:
    """A2: strongest decision per call; the last unit wins a tie, the first check inside it.

    Checks without a decision get no order and lose, so the long decision expression
    is evaluated once and not again for a filter.
    """
    order = F.struct(S.col(rank(S.ref("decision")["effect"])).alias("r"), F.col("pos"), (-F.col("idx")).alias("i"))
    best = rows.groupBy("call_id").agg(
        F.max_by("decision", F.when(F.col("decision").isNotNull(), order)).alias("decision"))
    return best.where("decision is not null")


def with_decision(calls: DataFrame, column: str, rules: RuleSet = RuleSet()) -> DataFrame:
    """P14-P24, J4, A2 inside the row: adds the strongest decision on the row's ``commands``, NULL if nothing decides.

    The steps are columns, so that each is analysed by itself; nothing is exploded or shuffled.
    """
    rules.check_inline()
    project = S.ref("project") if "project" in calls.columns else None
    judgement = f"struct<r:int,pos:array<int>,i:int,decision:{DECISION}>"
    found, every, best = f"{column}_units", f"{column}_checks", f"{column}_best"

    def of(unit: Sql) -> Sql:
        return S.transform(checks(unit, rules), lambda c, i: S.struct(
            c.alias("c"), unit["pos"].alias("pos"), (S.lit(0) - i).alias("i"), unit["container"].alias("container"),
            unit["uncertain"].alias("uncertain")))

    def judged(x: Sql) -> Sql:
        return S.let_as(judgement, check_decision(x["c"], x, rules, project), lambda d: S.when(d.isNotNull(), S.struct(
            rank(d["effect"]).alias("r"), x["pos"].alias("pos"), x["i"].alias("i"), d.alias("decision"))))

    staged = calls.withColumn(found, S.col(S.when(
        S.size(S.ref("commands")) > 0, units(S.ref("commands"), S.ref("cwd"))).otherwise(S.expr(_UNITS))))
    staged = staged.withColumn(every, S.col(S.flatten(S.transform(
        S.filter(S.ref(found), lambda u: u["audible"]), of))))
    staged = staged.withColumn(best, S.col(S.array_max(S.transform(S.ref(every), judged))))
    return staged.withColumn(column, F.col(best)["decision"]).drop(found, every, best)


def with_call_decision(calls: DataFrame, column: str, rules: RuleSet = RuleSet()) -> DataFrame:
    """Adds the command decision of a call: structured queries first, then its command lines.

    The row has tool_name, capability, cwd, queries (array) and commands (array).
    """
    kind, tool = S.ref("capability"), S.ref("tool_name")
    open_ = is_mcp(tool, kind) | (kind == "unknown")
    no_query = open_ & (S.size(S.ref("queries")) == 0) & database_tool(tool)
    first = S.get(S.filter(S.transform(S.ref("queries"), lambda q: query_decision(q, rules.tables)),
                           lambda d: d.isNotNull()), 0)
    by_query, own = f"{column}_query", f"{column}_commands"
    staged = calls.withColumn(by_query, S.col(S.when(no_query, decision("deny", "sql.ambiguous", "high", "sql")).when(
        open_, first).otherwise(S.lit(None).cast(DECISION))))
    relevant = S.ref(by_query).isNull() & (open_ | (kind == "shell_execute"))
    staged = staged.withColumn(own, F.col("commands")).withColumn("commands", S.col(
        S.when(relevant, S.ref("commands")).otherwise(S.expr(_STRINGS))))
    staged = with_decision(staged, f"{column}_command", rules)
    return staged.withColumn(column, F.coalesce(by_query, f"{column}_command")).withColumn("commands", F.col(own)).drop(
        by_query, own, f"{column}_command")


def verdicts(calls: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """(call_id, decision) of every call, the decision NULL where no command decided; no shuffle.

    As a generated row a decision is computed once, whatever reads it.
    """
    done = with_decision(calls, "_decision", rules)
    return done.select("call_id", F.explode(F.array("_decision")).alias("decision"))


def decisions(calls: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """(call_id, decision) of the calls whose queries or commands decided something; no shuffle."""
    done = with_call_decision(calls, "_decision", rules)
    return done.select("call_id", F.explode(F.array("_decision")).alias("decision")).where("decision is not null")


def _running(unit: Sql, body, kind: str) -> Sql:
    """``body`` of the name, arguments and rest of a unit that runs."""
    return S.when(unit["kind"] == "run", S.let_as(kind, program(unit["argv"]), lambda name: S.let_as(
        kind, args_of(unit["argv"]), lambda args: S.let_as(kind, _rest(name, args), lambda rest: body(name, args, rest)))))


def with_flow(calls: DataFrame, sinks_as: str = "sink", sources_as: str = "shown") -> DataFrame:
    """P25 and A6 inside the row: where a call sends data, and what its commands show.

    Adds the sink (of the tool, else of the first command that sends) and the struct
    (paths, sql): normalised paths and SQL texts whose content the commands show.
    """
    found = "_flow_units"
    shown = "struct<paths:array<string>,sql:string>"
    staged = calls.withColumn(found, S.col(S.when(
        S.size(S.ref("commands")) > 0, units(S.ref("commands"), S.ref("cwd"))).otherwise(S.expr(_UNITS))))

    def sends(unit: Sql) -> Sql:
        lost = ((unit["kind"] == "rule") & (S.element_at(unit["pos"], -1) == 3)) | (unit["rule"] == "shell.nesting_limit")
        return S.when(lost, "outbound_network").otherwise(_running(unit, sink, "string"))

    def shows(unit: Sql) -> Sql:
        def one(name: Sql, args: Sql, rest: Sql) -> Sql:
            paths = S.transform(read_paths(name, args), lambda p: normalize(unit["cwd"], p))
            return S.struct(S.filter(paths, lambda p: p.isNotNull()).alias("paths"), sql_text(name, args, rest).alias("sql"))

        return S.when(unit["cwd"].isNotNull(), _running(unit, one, shown))

    own = tool_sink(S.ref("tool_name"), S.ref("capability"), S.size(S.ref("urls")) > 0)
    ordered = S.array_sort(S.filter(S.transform(S.ref(found), lambda u: S.struct(
        u["pos"].alias("pos"), sends(u).alias("sink"))), lambda x: x["sink"].isNotNull()))
    every = S.filter(S.transform(S.ref(found), shows), lambda x: x.isNotNull())
    staged = staged.withColumn(sinks_as, S.col(S.coalesce(own, S.get(ordered, 0)["sink"])))
    staged = staged.withColumn("_shown", S.col(every))
    return staged.withColumn(sources_as, S.col(S.struct(
        S.flatten(S.transform(S.ref("_shown"), lambda x: x["paths"])).alias("paths"),
        S.filter(S.transform(S.ref("_shown"), lambda x: x["sql"]), lambda q: q.isNotNull()).alias("sql")))).drop(
        found, "_shown")


def sinks(calls: DataFrame) -> DataFrame:
    """P25: (call_id, sink) of every call that can send data out; the first command that does decides."""
    direct = calls.select("call_id", S.col(tool_sink(
        S.ref("tool_name"), S.ref("capability"), S.size(S.ref("urls")) > 0)).alias("sink"), "commands", "cwd")
    run = _parts(segments(direct.where("sink is null")))
    lost = (S.ref("kind") == "rule") & (S.element_at(S.ref("pos"), -1) == 3) | (S.ref("rule") == "shell.nesting_limit")
    found = run.withColumn("sink", S.col(S.when(lost, "outbound_network").when(
        S.ref("kind") == "run", sink(S.ref("_name"), S.ref("_args"), S.ref("_rest")))))
    by_command = found.where("sink is not null").groupBy("call_id").agg(F.min_by("sink", "pos").alias("sink"))
    return direct.where("sink is not null").select("call_id", "sink").unionByName(by_command)


def command_sources(calls: DataFrame) -> DataFrame:
    """Paths and SQL texts whose content the commands of a call show: (call_id, paths, sql), one row per call that has any."""
    bare = calls.withColumns({"tool_name": F.lit("Bash"), "capability": F.lit("shell_execute"),
                              "urls": F.expr(_STRINGS)})
    return with_flow(bare).select("call_id", F.explode(F.array("shown")).alias("s")).select("call_id", "s.*").where(
        "size(paths) > 0 or size(sql) > 0")
