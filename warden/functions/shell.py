"""Logged command lines as arrays: words, segments, wrappers.

Nothing is expanded or executed. A command that uses anything beyond words,
quotes, connectors and output redirection is reported as ambiguous.
"""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.paths import normalize
from warden.functions.sql import Sql
from warden.vocab import MAX_SHELL_TOKENS, MAX_STRING_BYTES, MAX_WRAPPERS

_WORD = r"""(?:[^ \t\r\n'"\\;&|><$`*?\[\](){}~]++|'[^']*+'|"(?:[^"\\$`]++|\\.)*+"|\\.)++"""
_MARK = r"&&|\|\||[|;\n]|>>|>"
_TOKEN = rf"(?s){_WORD}|{_MARK}"
_WHOLE = rf"(?s)^(?:{_WORD}|{_MARK}|[ \t\r])*+\z"
_CONNECTORS = (";", "\n", "&&", "||", "|")
_EMPTY = "cast(array() as array<string>)"
_SEGMENT = "struct<cwd:string,argv:array<string>,targets:array<string>,broken:boolean,moves:boolean,lost:boolean>"
_STEP = "struct<argv:array<string>,go:boolean>"

# --- fixed values: wrappers -------------------------------------------------
ENVIRONMENT_OVERRIDES = r"^(?:PATH|BASH_ENV|ENV|CDPATH|SHELLOPTS|BASHOPTS|LD_[A-Za-z0-9_]*|DYLD_[A-Za-z0-9_]*)="
OPAQUE_WRAPPERS = ("xargs", "eval", "exec")
# program: (flags, flags with a value, operands of its own)
WRAPPERS = {
    "env": (("-i", "--ignore-environment", "-0", "--null"), ("-u", "--unset"), 0),
    "command": (("-p",), (), 0),
    "timeout": (("--foreground", "--preserve-status", "-v", "--verbose"), ("-s", "--signal", "-k", "--kill-after"), 1),
    "nice": ((), ("-n", "--adjustment"), 0),
    "nohup": (("-f", "--fork", "-w", "--wait"), (), 0),
    "setsid": (("-f", "--fork", "-w", "--wait"), (), 0),
    "stdbuf": ((), ("-i", "-o", "-e", "--input", "--output", "--error"), 0),
    "busybox": ((), (), 0),
}


def _unquote(word: Sql) -> Sql:
    pieces = F.regexp_extract_all(word, r"""(?s)[^'"\\]++|'[^']*+'|"(?:[^"\\]++|\\.)*+"|\\.""", 0)
    plain = F.transform(pieces, lambda p: (
        F.when(p.startswith("'"), p.substr(2, F.length(p) - 2))
        .when(p.startswith('"'), F.regexp_replace(p.substr(2, F.length(p) - 2), r"(?s)\\(?:\n|(.))", "$1"))
        .when(p.startswith("\\"), F.regexp_replace(p, r"(?s)\\(?:\n|(.))", "$1"))
        .otherwise(p)))
    return F.when(word.rlike(r"""['"\\]"""), F.array_join(plain, "")).otherwise(word)


def _segment(raw: Sql) -> Sql:
    """struct(argv, targets, broken) of one piece between connectors."""
    is_mark = lambda t: t.isin(">", ">>")
    following = F.filter(F.transform(raw, lambda t, i: F.when(is_mark(t), F.struct(
        F.get(raw, i + 1).alias("word")))), lambda x: x.isNotNull())
    return F.struct(
        F.transform(F.filter(raw, lambda t: ~is_mark(t)), _unquote).alias("argv"),
        F.transform(F.filter(following, lambda x: x["word"].isNotNull() & ~is_mark(x["word"])),
                    lambda x: _unquote(x["word"])).alias("targets"),
        F.exists(following, lambda x: x["word"].isNull() | is_mark(x["word"])).alias("broken"),
        F.exists(raw, is_mark).alias("redirects"),
    )


def _segments(raw: Sql) -> Sql:
    ends = F.filter(F.transform(raw, lambda t, i: F.when(t.isin(*_CONNECTORS), i)), lambda i: i.isNotNull())
    parts = F.let_as("array<array<string>>", ends, lambda e: F.zip_with(
        F.concat(F.array(-1), e), F.concat(e, F.array(F.size(raw))),
        lambda a, b: F.slice(raw, a + 2, b - a - 1)))
    return F.transform(F.filter(parts, lambda p: F.size(p) > 0), _segment)


def segments(command: Sql, cwd: Sql) -> Sql:
    """array<struct(cwd, argv, targets, broken, moves, lost)> or NULL when ambiguous.

    ``moves`` marks a literal ``cd DIR``; it sets the directory of the segments after
    it. ``lost`` marks commands whose directory cannot be established.
    """
    usable = (F.octet_length(command) <= MAX_STRING_BYTES) & ~F.contains(command, "\0") & command.rlike(_WHOLE)

    def placed(raw: Sql, found: Sql) -> Sql:
        moving = F.exists(found, lambda s: F.get(s["argv"], 0) == "cd")
        loose = F.exists(raw, lambda t: t.isin(";", "\n", "||", "|"))
        odd = F.exists(found, lambda s: (F.get(s["argv"], 0) == "cd") & (
            (F.size(s["argv"]) != 2) | s["redirects"] | F.coalesce(F.get(s["argv"], 1), F.lit("")).rlike(r"^(?:-|\z)")))
        simple = F.transform(found, lambda s: F.struct(
            cwd.alias("cwd"), s["argv"].alias("argv"), s["targets"].alias("targets"), s["broken"].alias("broken"),
            F.lit(False).alias("moves"), F.lit(False).alias("lost")))

        def at(position: Sql) -> Sql:
            return F.aggregate(
                F.slice(found, 1, position), cwd,
                lambda here, s: F.when(F.get(s["argv"], 0) == "cd", normalize(here, F.get(s["argv"], 1)))
                .otherwise(here))

        moved = F.transform(found, lambda s, i: F.let_as(_SEGMENT, at(i), lambda here: F.struct(
            here.alias("cwd"), s["argv"].alias("argv"), s["targets"].alias("targets"), s["broken"].alias("broken"),
            (F.get(s["argv"], 0) == "cd").alias("moves"),
            (F.lit(False) | loose | odd | here.isNull()).alias("lost"))))
        return F.when(moving, moved).otherwise(simple)

    tokens = F.regexp_extract_all(command, _TOKEN, 0)
    return F.when(usable, F.let_as(f"array<{_SEGMENT}>", tokens, lambda raw: F.when(
        F.size(raw) <= MAX_SHELL_TOKENS, F.let_as(f"array<{_SEGMENT}>", _segments(raw), lambda found: placed(raw, found)))))


def rest_after_options(args: Sql, flags: Sql, values: Sql, strict: Sql) -> Sql:
    """Arguments after leading options; NULL when an option is not known.

    ``flags`` and ``values`` are arrays of option names. With ``strict`` off, unknown
    options are passed over, one argument each.
    """
    make = lambda skip, at, bad: F.struct(
        F.lit(skip).alias("skip"), F.lit(at).alias("at"), F.lit(bad).alias("bad"))

    def step(acc: Sql, a: Sql) -> Sql:
        word, i = a["word"], a["i"]
        attached = F.exists(values, lambda v: word.startswith(F.concat(v, F.lit("="))) | (
            (F.length(v) == 2) & word.startswith(v) & (F.length(word) > 2)))
        return (
            F.when((acc["at"] >= 0) | acc["bad"], acc)
            .when(acc["skip"], make(False, -1, False))
            .when(strict & (word == "--"), make(False, i + 1, False))
            .when(~word.startswith("-"), make(False, i, False))
            .when(F.array_contains(flags, word), acc)
            .when(F.array_contains(values, word) & (~strict | (i + 1 < F.size(args))), make(True, -1, False))
            .when(~strict | attached, acc)
            .otherwise(make(False, -1, True)))

    walked = F.aggregate(F.transform(args, lambda w, i: F.struct(w.alias("word"), i.alias("i"))),
                         make(False, -1, False), step)
    return F.let_as("array<string>", walked, lambda s: F.when(~s["bad"], F.when(
        s["at"] >= 0, F.slice(args, s["at"] + 1, F.size(args))).otherwise(F.expr(_EMPTY))))


def by_program(name: Sql, table: dict[str, tuple[str, ...]]) -> Sql:
    """The word list of a program as an array, empty for others."""
    ladder = None
    for program_, words in table.items():
        value = F.array(*words) if words else F.expr(_EMPTY)
        ladder = F.when(name == program_, value) if ladder is None else ladder.when(name == program_, value)
    return ladder.otherwise(F.expr(_EMPTY))


def program(argv: Sql) -> Sql:
    return F.substring_index(F.get(argv, 0), "/", -1)


def _unwrap_once(argv: Sql) -> Sql:
    """struct(argv, go): one wrapper less; argv NULL when the wrapper cannot be inspected."""
    assigned = F.size(F.filter(F.transform(argv, lambda w, i: F.exists(
        F.slice(argv, 1, i + 1), lambda x: ~x.rlike(r"(?s)^[A-Za-z0-9_]+="))), lambda stop: ~stop))
    override = F.exists(F.slice(argv, 1, assigned), lambda w: w.rlike(ENVIRONMENT_OVERRIDES))
    done = lambda value: F.struct(value.alias("argv"), F.lit(False).alias("go"))
    lost = done(F.lit(None).cast("array<string>"))

    def inner(words: Sql) -> Sql:
        name, args = program(words), F.slice(words, 2, F.size(words))
        rest = rest_after_options(
            args, by_program(name, {w: f for w, (f, _v, _n) in WRAPPERS.items()}),
            by_program(name, {w: v for w, (_f, v, _n) in WRAPPERS.items()}), F.lit(True))
        own = F.when(name == "timeout", 1).otherwise(0)
        return (
            F.when((F.size(words) > 0) & name.isin(*OPAQUE_WRAPPERS), lost)
            .when((F.size(words) > 0) & name.isin(*WRAPPERS), F.let_as(
                _STEP, F.when(name == "busybox", args).otherwise(rest),
                lambda r: F.when(F.coalesce(F.size(r) > own, F.lit(False)), F.struct(
                    F.slice(r, own + 1, F.size(r)).alias("argv"), F.lit(True).alias("go"))).otherwise(lost)))
            .otherwise(done(words)))

    return F.when(override, lost).otherwise(F.let_as(
        _STEP, F.slice(argv, assigned + 1, F.size(argv)), inner))


_LIKELY_WRAPPED = r"(?s)^(?:[A-Za-z0-9_]+=|(?:.*/)?(?:" + "|".join((*WRAPPERS, *OPAQUE_WRAPPERS)) + r")\z)"


def strip_wrappers(argv: Sql) -> Sql:
    """The wrapped command; NULL where a wrapper cannot be inspected or there are too many."""
    rounds = F.aggregate(
        F.sequence(1, MAX_WRAPPERS),
        F.struct(argv.alias("argv"), F.lit(True).alias("go")),
        lambda acc, _i: F.when(acc["go"] & acc["argv"].isNotNull(), _unwrap_once(acc["argv"])).otherwise(acc),
        lambda acc: F.when(~acc["go"], acc["argv"]),
    )
    # Nearly every command starts with its own program and is left as it is.
    return F.when(F.coalesce(F.get(argv, 0).rlike(_LIKELY_WRAPPED), F.lit(False)), rounds).otherwise(argv)
