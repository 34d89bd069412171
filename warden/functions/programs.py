"""What one command of a log does: fixed verdicts and file operands."""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.decisions import decision, none
from warden.functions.paths import is_absolute, normalize
from warden.functions.shell import by_program, rest_after_options
from warden.functions.sql import Sql
from warden.functions.statements import ambiguous
from warden.vocab import PROGRAM_SINKS

_STRINGS = "cast(array() as array<string>)"
CHECK = "struct<path:string,operation:string,tree:boolean,cwd:string,rule:string,effect:string,severity:string,category:string>"
CHECKS = f"array<{CHECK}>"
_NO_CHECKS = f"cast(array() as {CHECKS})"
_EXEC = "struct<inner:array<string>,dir:string,raw:boolean>"

# --- fixed values: program vocabularies -------------------------------------
CONTROL_WORDS = ("cd", "pushd", "popd", "if", "then", "else", "for", "while", "until", "do", "case", "!", "function")
LANGUAGES = ("python", "python3", "php", "node")
DRUSH_EVAL = ("php:eval", "php-eval", "ev")
DRUSH_FLAGS = ("-y", "--yes", "-n", "--no", "-v", "--verbose", "-q", "--quiet", "--no-interaction", "--debug")
DRUSH_VALUES = ("--root", "-r", "--uri", "-l", "--config", "-c", "--alias-path")
DRUSH_REVIEW = ("config:import", "config-import", "cim", "updatedb", "updb")
DRUSH_QUERY = ("sql:query", "sql-query", "sqlq")
COMPOSER_FLAGS = ("--no-interaction", "-n", "--no-plugins", "--no-scripts", "--no-progress", "-q", "--quiet", "-v",
                  "-vv", "-vvv", "--verbose", "--profile", "--ansi", "--no-ansi")
COMPOSER_VALUES = ("--working-dir", "-d")
GIT_VALUES = ("-C", "-c", "--git-dir", "--work-tree", "--namespace")
MYSQL_VALUES = ("-h", "--host", "-u", "--user", "-P", "--port", "-S", "--socket", "-D", "--database")
MYSQL_FLAGS = ("-B", "--batch", "-N", "--skip-column-names", "-t", "--table", "--no-defaults")
DDEV_SAFE = ("start", "describe", "status", "version", "list", "logs", "stop", "restart")
READERS = ("cat", "head", "tail", "less", "more", "sed", "awk", "wc")
# program: effect of an option, then the ways to write it; V stands for its value.
OPTION_TABLE = (
    ("cp mv rm install", "target", "-t V", "-tV", "--target-directory V", "--target-directory=V"),
    ("cp mv rm install", "value", "--suffix V"),
    ("cp mv rm", "unclear", "-m V", "--mode V", "-o V", "--owner V", "-g V", "--group V"),
    ("install", "value", "-m V", "--mode V", "-o V", "--owner V", "-g V", "--group V"),
    ("cp mv rm install", "flag", "--recursive", "--force", "--preserve", "--no-preserve", "--verbose",
     "--no-target-directory", "--mode=V", "--owner=V", "--group=V", "--suffix=V", "--preserve=V", "--no-preserve=V"),
    ("grep rg", "read", "-f V", "-fV", "--file V", "--file=V"),
    ("grep rg", "pattern", "-e V", "-eV", "--regexp V", "--regexp=V"),
    ("grep rg", "value", "-A V", "--after-context V", "-B V", "--before-context V", "-C V", "--context V", "-g V",
     "--glob V", "--iglob V", "-j V", "--threads V", "-m V", "--max-count V", "--max-columns V", "--max-depth V",
     "--path-separator V", "-t V", "--type V", "-T V", "--type-not V", "--type-add V", "--encoding V", "--engine V",
     "--sort V", "--sortr V"),
    ("rg", "value", "-r V", "--replace V"),
    ("curl", "write", "-o V", "-o=V", "--output V", "--output=V", "--output-dir V", "--output-dir=V"),
    ("curl", "write attached", "-oV"),
    ("curl", "write by server", "-O", "--remote-name", "--remote-name-all", "-J", "--remote-header-name"),
    ("curl", "data", "-d V", "-dV", "--data V", "--data=V", "--data-binary V", "--data-binary=V", "--data-ascii V",
     "--data-ascii=V"),
    ("curl", "encoded", "--data-urlencode V", "--data-urlencode=V"),
    ("curl", "form", "-F V", "-FV", "--form V", "--form=V"),
    ("curl", "send", "-T V", "-TV", "--upload-file V", "--upload-file=V", "-K V", "-KV", "--config V", "--config=V"),
    ("wget", "write", "-O V", "-O=V", "--output-document V", "--output-document=V", "-P V", "-P=V",
     "--directory-prefix V", "--directory-prefix=V"),
    ("wget", "write attached", "-OV", "-PV"),
    ("wget", "send whole", "--post-file V", "--post-file=V", "--body-file V", "--body-file=V", "--input-file V",
     "--input-file=V", "-i V"),
    ("ddev exec", "service", "-s V", "-s=V", "--service V", "--service=V"),
    ("ddev exec", "dir", "-d V", "-d=V", "--dir V", "--dir=V"),
    ("ddev exec", "raw", "--raw", "--raw=V"),
)
# How a program reads its arguments besides: unknown options that make the command unclear, whether a value may be read
# as an option too, whether -- ends the options, whether the first operand does, and whether a lone - is an operand.
READING = {
    "cp": dict(unclear="--"), "install": dict(unclear="--"), "grep": dict(dash=True), "rg": dict(dash=True),
    "curl": dict(peeks=True, ends=False), "wget": dict(peeks=True, ends=False),
    "ddev exec": dict(unclear="-", stops=True),
}


def args_of(argv: Sql) -> Sql:
    return F.slice(argv, 2, F.size(argv))


def after(args: Sql, at) -> Sql:
    return F.slice(args, at, F.size(args))


def some(args: Sql, *names: str) -> Sql:
    return F.exists(args, lambda a: a.isin(*names))


def short_flag(arg: Sql, letters: str) -> Sql:
    """A bundle of one-letter options that holds one of ``letters``."""
    return arg.rlike(rf"(?s)^-(?!-).*[{letters}]")


# --- options -----------------------------------------------------------------

WORDS = "array<struct<effect:string,flag:string,value:string>>"


def _effect(program: str, key: Sql, shape: str) -> Sql:
    """Effect of an option of a program that is written in one shape: "V" with the value apart, "=V", "V" attached or bare."""
    ladder = None
    for programs, effect, *ways in OPTION_TABLE:
        if program not in programs.split(" ") and program != programs:
            continue
        ends = {"apart": " V", "joined": "=V", "attached": "V", "bare": ""}
        names = [way.removesuffix(ends[shape]) for way in ways if _shape(way) == shape]
        if names:
            ladder = F.when(key.isin(*names), effect) if ladder is None else ladder.when(key.isin(*names), effect)
    return F.lit(None).cast("string") if ladder is None else ladder.otherwise(None)


def _shape(way: str) -> str:
    return "apart" if way.endswith(" V") else "joined" if way.endswith("=V") else "attached" if way.endswith("V") else "bare"


def words(program: str, args: Sql) -> Sql:
    """Arguments as (effect, flag, value): every option by OPTION_TABLE, every other word as an operand.

    An option whose value is missing has the value NULL; unknown options are flags, or unclear.
    """
    how = dict(unclear=None, peeks=False, ends=True, stops=False, dash=False) | READING[program]
    one = lambda effect, flag, value: F.array(F.struct(
        F.lit(effect).alias("effect"), F.lit(flag).cast("string").alias("flag"), F.lit(value).cast("string").alias("value")))
    state = f"struct<skip:boolean,only:boolean,out:{WORDS}>"
    to = lambda skip, only, out: F.struct(
        F.lit(skip).alias("skip"), F.lit(only).alias("only"), out.alias("out")).cast(state)

    def step(acc: Sql, a: Sql) -> Sql:
        word, only, out = a["word"], acc["only"], acc["out"]
        head, tail = F.substring_index(word, "=", 1), word.substr(F.instr(word, "=") + 1, F.length(word))
        add = lambda more, skip=False, last=only: to(skip, last, F.concat(out, more))
        operand = only | ~word.startswith("-") | (F.lit(how["dash"]) & (word == "-"))
        ladder = F.when(acc["skip"], to(False, only, out)).when(
            operand, add(one("operand", None, word), last=F.lit(True) if how["stops"] else only))
        if how["ends"]:
            ladder = ladder.when(word == "--", to(False, True, out))
        apart, joined, attached, bare = (
            _effect(program, word, "apart"), _effect(program, head, "joined"),
            _effect(program, F.substring(word, 1, 2), "attached"), _effect(program, word, "bare"))
        unknown = F.lit("flag") if how["unclear"] is None else F.when(
            word.startswith(how["unclear"]), "unclear").otherwise("flag")
        return (
            ladder.when(apart.isNotNull(), add(one(apart, word, a["next"]), skip=not how["peeks"]))
            .when(F.contains(word, "=") & joined.isNotNull(), add(one(joined, head, tail)))
            .when((F.length(word) > 2) & ~word.startswith("--") & attached.isNotNull(), add(one(
                attached, F.substring(word, 1, 2), word.substr(3, F.length(word)))))
            .otherwise(add(one(F.coalesce(bare, unknown), word, None))))

    return F.aggregate(
        F.transform(args, lambda w, i: F.struct(w.alias("word"), F.get(args, i + 1).alias("next"))),
        to(False, False, F.expr(f"cast(array() as {WORDS})")), step, lambda s: s["out"])


def values(found: Sql, *effects: str) -> Sql:
    """Values of the words with one of these effects."""
    return F.transform(F.filter(found, lambda w: w["effect"].isin(*effects)), lambda w: w["value"])


def has(found: Sql, *effects: str) -> Sql:
    return F.exists(found, lambda w: w["effect"].isin(*effects))


# --- fixed verdicts ----------------------------------------------------------

OPTIONS = {"drush": (DRUSH_FLAGS, DRUSH_VALUES), "composer": (COMPOSER_FLAGS, COMPOSER_VALUES), "git": ((), GIT_VALUES)}


def command_args(name: Sql, args: Sql) -> Sql:
    """What follows the global options of drush, composer and git; NULL when unclear."""
    return F.when(name.isin(*OPTIONS), rest_after_options(
        args, by_program(name, {n: f for n, (f, _) in OPTIONS.items()}),
        by_program(name, {n: v for n, (_, v) in OPTIONS.items()}), name != "git"))


def drush(args: Sql, rest: Sql, by_query: Sql) -> Sql:
    command = F.get(rest, 0)
    return (
        F.when(some(args, *DRUSH_EVAL), decision("deny", "shell.drush.eval", "critical", "drush"))
        .when(rest.isNull(), ambiguous())
        .when(command.isin("sql:dump", "sql-dump"), decision("deny", "shell.drush.sql_dump", "high", "drush"))
        .when(command.isin("sql:cli", "sql-cli"), decision("deny", "shell.drush.sql_cli", "high", "drush"))
        .when(command.isin(*DRUSH_REVIEW), decision("ask", "drush.mutation.review", "medium", "drush"))
        .when(command.isin(*DRUSH_QUERY), F.when(
            (F.size(rest) == 2) & ~F.get(rest, 1).rlike(r"^(?:-|\z)"), by_query).otherwise(ambiguous())))


def composer(rest: Sql) -> Sql:
    return (
        F.when(rest.isNull(), decision("deny", "composer.ambiguous", "high", "composer"))
        .when(F.get(rest, 0).isin("require", "remove", "update", "install"),
              decision("ask", "composer.dependencies.modify", "medium", "composer"))
        .when(F.get(rest, 0).isin("run-script", "run", "exec"),
              decision("ask", "composer.scripts.execute", "high", "composer")))


def git(args: Sql, rest: Sql) -> Sql:
    c = F.get(rest, 0)
    forced = F.exists(args, lambda a: a.rlike(
        r"(?s)^(?:--force|--force-with-lease|--force-if-includes)\z|^--force=|^--force-with-lease=|^\+|^-(?!-).*f"))
    return (
        F.when((c == "push") & forced, decision("deny", "git.force_push", "high", "git"))
        .when((c == "config") & F.exists(args, lambda a: F.contains(F.lower(a), "credential.")),
              decision("deny", "git.credential_config", "high", "git"))
        .when(c.isin("commit", "push"), decision("ask", "git.write.review", "medium", "git")))


def client_query(args: Sql, positional: Sql) -> Sql:
    """The one SQL text a database client is given; NULL when there is none or it is unclear."""
    state = "struct<query:string,mode:string,bad:boolean>"
    make = lambda q, m, b: F.struct(
        F.lit(q).alias("query"), F.lit(m).alias("mode"), F.lit(b).alias("bad")).cast(state)
    start = make(F.lit(None).cast("string"), "", False)
    known = rf"(?s)^(?:--(?:host|user|port|socket|database)=.|-[huPSD].)"

    def step(acc: Sql, arg: Sql) -> Sql:
        took = lambda v: F.when(
            acc["query"].isNotNull() | (v == ""), make(acc["query"], "", True)).otherwise(make(v, "", acc["bad"]))
        ladder = (
            F.when(acc["mode"] == "query", took(arg))
            .when(acc["mode"] == "value", make(acc["query"], "", acc["bad"]))
            .when(arg.isin("-e", "--execute"), make(acc["query"], "query", acc["bad"]))
            .when(arg.startswith("--execute="), took(arg.substr(11, F.length(arg))))
            .when(arg.rlike("(?s)^-e."), took(arg.substr(3, F.length(arg))))
            .when(arg.startswith("--init-command") | arg.isin("--binary-mode", "--force"), make(acc["query"], "", True)))
        ladder = ladder.when(
            positional & (F.size(args) == 1) & ~arg.startswith("-"), make(arg, "", acc["bad"]))
        return (
            ladder.when(arg.isin(*MYSQL_VALUES), make(acc["query"], "value", acc["bad"]))
            .when(arg.startswith("-") & ~arg.isin(*MYSQL_FLAGS) & ~arg.rlike(known), make(acc["query"], "", True))
            .otherwise(acc))

    return F.let_as("string", F.aggregate(args, start, step), lambda s: F.when(~s["bad"] & (s["mode"] == ""), s["query"]))


def ddev_blocked(rule: str) -> Sql:
    return decision("deny", rule, "high", "ddev")


def ddev(rest: Sql, by_query: Sql) -> Sql:
    """Fixed verdict of a ddev command that runs nothing inside the container."""
    command, more = F.get(rest, 0), after(rest, 2)
    return (
        F.when(rest.isNull(), ddev_blocked("ddev.context.unknown"))
        .when(F.size(rest) == 0, none())
        .when(command == "ssh", ddev_blocked("ddev.shell_escape"))
        .when(command.isin("import-db", "export-db"), ddev_blocked("ddev.database_transfer"))
        .when(command == "mysql", by_query)
        .when(command.isin("delete", "snapshot", "restore"), ddev_blocked("ddev.database_mutation"))
        .when((command == "stop") & F.exists(more, lambda a: a.startswith("--remove-data")),
              ddev_blocked("ddev.database_mutation"))
        .when(command.isin(*DDEV_SAFE), none())
        .otherwise(ddev_blocked("ddev.command.unknown")))


def ddev_rest(args: Sql) -> Sql:
    """Arguments after ddev's global options; NULL for any other option."""
    first = F.array_position(F.transform(args, lambda a: a.isin("--yes", "-y", "--verbose", "-v")), False).cast("int")
    return F.when(first == 0, F.expr(_STRINGS)).when(~F.get(args, first - 1).startswith("-"), after(args, first))


def ddev_exec(args: Sql) -> Sql:
    """struct(inner, dir, raw) of ``ddev exec``; NULL when its context is not known."""
    def read_(found: Sql) -> Sql:
        odd = F.exists(found, lambda w: (
            F.when(w["effect"] == "service", ~F.coalesce(w["value"] == "web", F.lit(False)))
            .when(w["effect"] == "dir", w["value"].isNull() | ~is_absolute(w["value"]))
            .when(w["effect"] == "raw", F.coalesce(w["value"] != "true", F.lit(False)))
            .otherwise(w["effect"] == "unclear")))
        return F.let_as(_EXEC, values(found, "operand"), lambda inner: F.when(~odd & (F.size(inner) > 0), F.struct(
            inner.alias("inner"), F.get(F.reverse(values(found, "dir")), 0).alias("dir"), has(found, "raw").alias("raw"))))

    return F.let_as(_EXEC, words("ddev exec", args), read_)


def literal(args: Sql) -> Sql:
    """The container shell will read exactly these arguments."""
    return F.forall(args, lambda a: (a != "") & F.when(
        a.rlike('["  \\t\\r\\n#]'), ~a.rlike(r"[$`\\]")).otherwise(
        ~a.rlike(r"[$`\\';|&<>*?\[\](){}~]")))


def sql_text(name: Sql, args: Sql, rest: Sql) -> Sql:
    """The SQL text a command runs, else NULL. ``rest`` is what follows global options."""
    in_container = (name == "ddev") & (F.get(rest, 0) == "mysql")
    return (
        F.when((name == "drush") & (F.size(rest) == 2) & F.get(rest, 0).isin(*DRUSH_QUERY), F.get(rest, 1))
        .when((name == "mysql") | in_container, client_query(
            F.when(name == "mysql", args).otherwise(after(rest, 2)), name == "ddev")))


def fixed(name: Sql, args: Sql, rest: Sql, by_query: Sql) -> Sql:
    """Verdict of a command that does not depend on any path.

    ``by_query`` is the verdict on the SQL text of the command, for commands with one.
    """
    return (
        F.when(name.isin(*CONTROL_WORDS), decision("deny", "shell.ambiguous", "high", "shell"))
        .when(name.isin("sudo", "su"), decision("deny", "shell.privilege_escalation", "critical", "shell"))
        .when(name.isin(*LANGUAGES) & F.coalesce(F.get(args, 0).isin("-c", "-r", "-e"), F.lit(False)),
              decision("deny", "shell.language_eval", "high", "shell"))
        .when(name == "drush", drush(args, rest, by_query))
        .when(name == "composer", composer(rest))
        .when(name == "git", git(args, rest))
        .when(name == "mysql", by_query)
        .when(name == "ddev", ddev(rest, by_query)))


# --- file operands -----------------------------------------------------------

def read(path: Sql, cwd: Sql) -> Sql:
    return check(path, "read", False, cwd)


def check(path, operation: str, tree: bool, cwd: Sql) -> Sql:
    null = F.lit(None)
    return F.struct(F.lit(path).alias("path"), F.lit(operation).alias("operation"), F.lit(tree).alias("tree"),
                    cwd.alias("cwd"), null.alias("rule"), null.alias("effect"), null.alias("severity"),
                    null.alias("category")).cast(CHECK)


def verdict_check(d: Sql) -> Sql:
    null = F.lit(None)
    return F.struct(null.alias("path"), null.alias("operation"), F.lit(False).alias("tree"), null.alias("cwd"),
                    d["rule_id"].alias("rule"), d["effect"].alias("effect"), d["severity"].alias("severity"),
                    d["category"].alias("category")).cast(CHECK)


def shell_rule(rule: str, category: str = "shell", severity: str = "high") -> Sql:
    return F.array(verdict_check(decision("deny", rule, severity, category)))


def no_checks() -> Sql:
    return F.expr(_NO_CHECKS)


def operands(args: Sql) -> Sql:
    return F.filter(args, lambda a: ~a.startswith("-"))


def _copies(name: Sql, args: Sql, cwd: Sql) -> Sql:
    """Targets and sources of cp, mv, install and rm."""
    clustered = F.exists(args, lambda a: a.rlike(r"(?s)^-(?![-t]).*t"))
    whole = F.exists(args, lambda a: (a == "--recursive") | short_flag(a, "rRa"))

    def built(found: Sql, named: Sql, rest: Sql) -> Sql:
        open_ = has(found, "unclear") | F.exists(
            found, lambda w: w["effect"].isin("target", "value") & w["value"].isNull())
        to = F.coalesce(F.get(F.reverse(named), 0), F.get(F.reverse(rest), 0))
        from_ = F.when(F.size(named) > 0, rest).otherwise(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))))
        taken = lambda p: F.when(name == "mv", F.array(read(p, cwd), check(p, "write", True, cwd))).otherwise(
            F.array(read(p, cwd)))
        return (
            F.when(open_ | ((name != "rm") & (to.isNull() | clustered)), shell_rule("filesystem.ambiguous"))
            .when(name == "rm", F.transform(rest, lambda p: check(p, "write", True, cwd)))
            .otherwise(F.concat(F.array(check(to, "write", whole, cwd)), F.flatten(F.transform(from_, taken)))))

    found = F.when(name == "install", words("install", args)).otherwise(words("cp", args))
    return F.let_as(CHECKS, found, lambda w: F.let_as(CHECKS, values(w, "target"), lambda t: F.let_as(
        CHECKS, values(w, "operand"), lambda o: built(w, t, o))))


def _pick(args: Sql, chosen) -> Sql:
    """``chosen(arg, next arg)`` of every argument, without the NULLs."""
    return F.filter(F.transform(args, lambda a, i: chosen(a, F.get(args, i + 1))), lambda x: x.isNotNull())


def _transfers(name: Sql, args: Sql, cwd: Sql) -> Sql:
    """Files curl and wget write, then those they send."""
    def built(found: Sql) -> Sql:
        into = F.filter(found, lambda w: (w["effect"] == "write") | (
            (w["effect"] == "write attached") & ~F.contains(w["value"], "=")))
        written = F.let_as(CHECKS, into, lambda o: F.when(
            F.exists(o, lambda w: w["value"].isNull()) | has(found, "write by server") | ((name == "wget") & (F.size(o) == 0)),
            shell_rule("filesystem.ambiguous")).otherwise(F.transform(o, lambda w: check(w["value"], "write", False, cwd))))
        return F.concat(written, F.transform(sent(found), lambda p: read(p, cwd)))

    return F.let_as(CHECKS, _transfer_words(name, args), built)


def _transfer_words(name: Sql, args: Sql) -> Sql:
    return F.when(name == "curl", words("curl", args)).when(name == "wget", words("wget", args))


def sent(found: Sql) -> Sql:
    """Local files among the words of a transfer command."""
    def file_of(w: Sql) -> Sql:
        value, beyond = w["value"], lambda mark: w["value"].substr(
            F.instr(w["value"], mark) + 1, F.length(w["value"]))
        return F.when(w["effect"] == "send whole", value).otherwise(F.substring_index(
            F.when(w["effect"] == "send", value)
            .when((w["effect"] == "data") & value.startswith("@"), beyond("@"))
            .when((w["effect"] == "encoded") & F.contains(value, "@"), beyond("@"))
            .when((w["effect"] == "form") & value.rlike("(?s)^[^=]*=[@<]"), beyond("=").substr(2, F.length(value))), ";", 1))

    return F.filter(F.transform(found, file_of), lambda p: p.isNotNull())


def uploads(name: Sql, args: Sql) -> Sql:
    """P20: local files a transfer command sends."""
    return F.let_as("array<string>", _transfer_words(name, args), sent)


def _git_objects(args: Sql, cwd: Sql) -> Sql:
    """Paths of ``git show`` and ``git cat-file``."""
    state = "struct<at:int,take:string,cwd:string,rule:string>"
    make = lambda at, take, here, rule: F.struct(
        F.lit(at).alias("at"), F.lit(take).alias("take"), here.alias("cwd"), F.lit(rule).alias("rule")).cast(state)

    def step(acc: Sql, a: Sql) -> Sql:
        word, i = a["word"], a["i"]
        return (
            F.when((acc["at"] >= 0) | acc["rule"].isNotNull(), acc)
            .when(acc["take"] == "cwd", F.let_as(state, normalize(acc["cwd"], word), lambda n: F.when(
                n.isNull(), make(-1, "", acc["cwd"], "guard.evaluation_error")).otherwise(make(-1, "", n, None))))
            .when(acc["take"] == "value", make(-1, "", acc["cwd"], None))
            .when(word == "-C", make(-1, "cwd", acc["cwd"], None))
            .when(word.startswith("--git-dir") | word.startswith("--work-tree"),
                  make(-1, "", acc["cwd"], "git.context.unknown"))
            .when(word == "-c", make(-1, "value", acc["cwd"], None))
            .when(word.startswith("-"), acc)
            .otherwise(make(i, "", acc["cwd"], None)))

    walked = F.aggregate(F.transform(args, lambda w, i: F.struct(w.alias("word"), i.alias("i"))),
                         make(-1, "", cwd, None), step)
    selected = lambda rest: _pick(rest, lambda a, _n: F.when(F.contains(a, ":"), F.regexp_replace(
        a.substr(F.instr(a, ":") + 1, F.length(a)), "^[0-3]:", "")))

    def built(s: Sql) -> Sql:
        return (
            F.when(s["rule"] == "git.context.unknown", shell_rule("git.context.unknown"))
            .when(s["rule"].isNotNull() | (s["take"] == "cwd"), shell_rule("guard.evaluation_error", "guard", "critical"))
            .when(F.get(args, F.when(s["at"] >= 0, s["at"]).otherwise(F.size(args))).isin("show", "cat-file"),
                  F.let_as(CHECKS, selected(after(args, s["at"] + 2)), lambda p: F.when(
                      F.size(p) == 0, shell_rule("git.read.opaque_object")).otherwise(
                      F.transform(p, lambda x: read(x, s["cwd"])))))
            .otherwise(no_checks()))

    return F.let_as(CHECKS, walked, built)


def search_paths(name: Sql, args: Sql) -> Sql:
    """File operands of grep and rg; the first operand is the expression unless -e or -f came before it."""
    def built(found: Sql) -> Sql:
        first = F.array_position(F.transform(found, lambda w: w["effect"]), "operand").cast("int")
        given = has(F.slice(found, 1, F.greatest(first - 1, F.lit(0))), "pattern", "read")
        return F.let_as("array<string>", F.when(given, 0).otherwise(first), lambda expression: F.transform(
            F.filter(found, lambda w, i: (w["effect"] == "read") | ((w["effect"] == "operand") & (i + 1 != expression))),
            lambda w: w["value"]))

    known = F.when(name == "rg", words("rg", args)).otherwise(words("grep", args))
    # A last option without its value says nothing.
    return F.let_as("array<string>", F.filter(known, lambda w: w["value"].isNotNull()), built)


def excluded(args: Sql) -> Sql:
    """Patterns ``rg`` leaves out; an inclusion after them takes them back."""
    globs = F.filter(F.transform(args, lambda a, i: (
        F.when(F.coalesce(F.get(args, i - 1).isin("-g", "--glob"), F.lit(False)), a)
        .when(a.isin("-g", "--glob"), F.lit(None))
        .when(a.startswith("--glob="), a.substr(8, F.length(a)))
        .when(a.rlike("(?s)^-g."), a.substr(3, F.length(a))))), lambda g: g.isNotNull())
    return F.aggregate(globs, F.expr(_STRINGS), lambda out, g: F.when(
        g.startswith("!"), F.array_append(out, g.substr(2, F.length(g)))).otherwise(F.expr(_STRINGS)))


def _search(name: Sql, args: Sql, cwd: Sql, protected: list[str]) -> Sql:
    """Operands of a search, then whether it reads a whole tree."""
    recursive = F.exists(args, lambda a: a.isin("--recursive", "--dereference-recursive") | short_flag(a, "rR"))
    open_ended = some(args, "-L", "--follow", "--pre", "--pre-glob", "--iglob") | F.exists(
        args, lambda a: a.rlike("^--(?:pre|iglob)="))
    covered = (name == "rg") & ~open_ended & (
        F.size(F.array_except(F.array(*[F.lit(p) for p in protected]), excluded(args))) == 0)

    def built(found: Sql) -> Sql:
        bulk = some(args, "--files") | recursive | (F.size(found) == 0) | F.exists(
            found, lambda p: p.isin(".", "..") | p.endswith("/") | ~F.contains(F.substring_index(p, "/", -1), "."))
        return F.concat(F.transform(found, lambda p: read(p, cwd)),
                        F.when(bulk & ~covered, shell_rule("filesystem.read.bulk")).otherwise(no_checks()))

    return F.let_as(CHECKS, search_paths(name, args), built)


def path_checks(name: Sql, args: Sql, cwd: Sql, protected: list[str]) -> Sql:
    """Operands of one command, in the order in which the first hit decides."""
    reads = lambda paths: F.transform(paths, lambda p: read(p, cwd))
    writes = lambda paths: F.transform(paths, lambda p: check(p, "write", False, cwd))
    in_place = F.exists(args, lambda a: (a == "--in-place") | a.startswith("--in-place=") | short_flag(a, "i"))
    early = F.slice(args, 1, F.greatest(F.size(args) - 1, F.lit(0)))
    return (
        F.when(name.isin("cp", "mv", "install", "rm"), F.concat(_copies(name, args, cwd), F.when(
            name.isin("cp", "mv"), reads(operands(early))).otherwise(no_checks())))
        .when(name.isin("curl", "wget"), _transfers(name, args, cwd))
        .when(name.isin("scp", "sftp", "rsync"), reads(
            F.filter(args, lambda a: ~a.startswith("-") & ~F.contains(a, ":"))))
        .when(name == "git", _git_objects(args, cwd))
        .when(name.isin("grep", "rg"), _search(name, args, cwd, protected))
        .when(name.isin(*READERS), F.concat(
            F.when((name == "sed") & in_place, writes(operands(args))).otherwise(no_checks()), reads(operands(args))))
        .when(name.isin("touch", "mkdir", "tee"), writes(operands(args)))
        .otherwise(no_checks()))


# --- data flow ---------------------------------------------------------------

def sink(name: Sql, args: Sql, rest: Sql) -> Sql:
    """P25: outbound kind of one command."""
    ladder = None
    for kind, names in PROGRAM_SINKS.items():
        ladder = F.when(name.isin(*names), kind) if ladder is None else ladder.when(name.isin(*names), kind)
    return (
        ladder.when((name == "rsync") & F.exists(args, lambda a: F.contains(a, ":")), "remote_file_transfer")
        .when((name == "git") & (F.get(rest, 0) == "push"), "git_remote_write"))


def read_paths(name: Sql, args: Sql) -> Sql:
    """Paths whose content a command shows or copies."""
    early = F.slice(args, 1, F.greatest(F.size(args) - 1, F.lit(0)))
    return F.when(name.isin(*READERS), operands(args)).when(name.isin("cp", "mv"), operands(early)).otherwise(
        F.expr(_STRINGS))
