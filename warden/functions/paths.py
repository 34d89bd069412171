"""Lexical path handling on columns."""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.sql import Sql

from warden.vocab import MAX_PATH_BYTES


def is_windows(path: Sql) -> Sql:
    """Drive-rooted or UNC path, with either slash."""
    return path.rlike(r"^[A-Za-z]:[/\\]") | (
        path.rlike(r"^(?://[^/\\]|\\\\[^/\\])") & (F.octet_length(path) >= 5)
    )


def is_absolute(path: Sql) -> Sql:
    return path.startswith("/") | is_windows(path)


def _resolve(full: Sql) -> Sql:
    """Components of a slash path with empty, ``.`` and ``..`` parts worked off."""
    return F.aggregate(
        F.filter(F.split(full, "/"), lambda p: ~p.isin("", ".")),
        F.expr("cast(array() as array<string>)"),
        lambda kept, p: F.when(
            p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.array_append(kept, p)),
    )


def bad_component(component: Sql) -> Sql:
    """A component Windows would read as a device, an alias or a pattern."""
    stem = F.upper(F.substring_index(component, ".", 1))
    return (
        stem.rlike("^(?:CON|PRN|AUX|NUL|CONIN[$]|CONOUT[$]|(?:COM|LPT)[1-9¹²³])$")
        | component.rlike(r"[. ]\z")
        | component.rlike(r'[:<>"|?*~]|\p{Cc}')
    )


def _posix(cwd: Sql, path: Sql) -> Sql:
    full = F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    # Most logged paths need no work; only the others are taken apart.
    return F.let_as("string", full, lambda f: F.when(
        f.rlike(r"//|/\.{1,2}(?:/|\z)|/\z"), F.concat(F.lit("/"), F.array_join(_resolve(f), "/"))).otherwise(f))


# Drive (upper-cased later) or server and share, then the rest of a path.
_ROOT = r"(?s)^([A-Za-z]:(?=/)|//+[^/]+/+[^/]+)(.*)"


def _windows(cwd: Sql, path: Sql) -> Sql:
    """Paths seen from a Windows directory; both slashes separate, the root stays under ``..``."""
    sides = F.struct(F.translate(cwd, "\\", "/").alias("cwd"), F.translate(path, "\\", "/").alias("path"))

    def rooted(x: Sql) -> Sql:
        own = is_windows(x["path"])
        base = F.when(own, x["path"]).otherwise(x["cwd"])
        below = F.regexp_extract(base, _ROOT, 2)
        return F.struct(
            F.regexp_extract(base, _ROOT, 1).alias("root"),
            F.when(own, below).when(x["path"].startswith("/"), x["path"])
            .otherwise(F.concat(below, F.lit("/"), x["path"])).alias("below"),
            F.concat_ws("/", F.regexp_extract(x["cwd"], _ROOT, 2), F.when(own, below).otherwise(x["path"])).alias("seen"),
            (own | ~x["path"].rlike("^[A-Za-z]:")).alias("usable"))

    def built(r: Sql) -> Sql:
        drive = r["root"].rlike("^[A-Za-z]:")
        root = F.when(drive, F.upper(r["root"])).otherwise(F.regexp_replace(r["root"], "/+([^/]+)/+([^/]+)", "//$1/$2"))
        names = F.filter(F.split(F.concat(
            r["seen"], F.when(drive, "").otherwise(F.concat(F.lit("/"), r["root"]))), "/"), lambda c: ~c.isin("", ".", ".."))
        usable = r["usable"] & (r["root"] != "") & ~r["root"].rlike(r"^//.*/\.{1,2}\z|^//+\.{1,2}/") & ~F.exists(
            names, bad_component)
        return F.when(usable, F.let_as("string", F.array_join(_resolve(r["below"]), "/"), lambda tail: F.concat(
            root, F.when((tail != "") | drive, "/").otherwise(""), tail)))

    return F.let_as("string", F.let(sides, rooted), built)


def normalize(cwd: Sql, path: Sql) -> Sql:
    """Absolute form of ``path`` as seen from ``cwd``; NULL where it is not valid."""
    def checked(x: Sql) -> Sql:
        here, there = x["cwd"], x["path"]
        usable = (
            (there != "") & (F.octet_length(here) <= MAX_PATH_BYTES) & (F.octet_length(there) <= MAX_PATH_BYTES)
            & ~F.contains(here, "\0") & ~F.contains(there, "\0"))
        result = F.when(is_windows(here), _windows(here, there)).when(here.startswith("/"), _posix(here, there))
        return F.when(usable, F.let_as("string", result, lambda n: F.when(F.octet_length(n) <= MAX_PATH_BYTES, n)))

    return F.let_as("string", F.struct(cwd.alias("cwd"), path.alias("path")), checked)


def basename(path: Sql) -> Sql:
    return F.substring_index(path, "/", -1)


def covers(directory: Sql, prefix: list[str], matched: Sql) -> Sql:
    """P10: ``directory`` holds what a pattern with this literal ``prefix`` protects.

    ``matched`` says whether the pattern itself matches the directory. A pattern
    without literal components protects something below every directory.
    """
    if not prefix:
        return F.lit(True)
    if len(prefix) == 1:
        return matched
    lowered = F.lower(directory)
    heads = ["/".join(prefix[:n]).lower() for n in range(1, len(prefix))]
    ends = [
        lowered.endswith("/" + head) | lowered.isin(head, "/" + head) for head in heads
    ]
    found = matched
    for end in ends:
        found = found | end
    return found
