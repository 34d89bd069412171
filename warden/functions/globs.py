"""Path and table globs, turned into regular expressions once per rule."""

from __future__ import annotations

import re
from dataclasses import dataclass

_ANYWHERE = "(?:.*/)?"
_WINDOWS_HEAD = "(?=[A-Za-z]:/|//[^/])"


def _body(pattern: str) -> str:
    """Regex for one glob: ``*`` and ``?`` stay inside a component, ``**`` crosses them."""
    out, rest = [], pattern
    while rest.startswith("**/"):
        rest = rest[3:]
        if not out:
            out.append(_ANYWHERE)
    depth = 0
    pos = 0
    while pos < len(rest):
        if rest.startswith("/**/", pos):
            out.append("/(?:.*/)?")
            pos += 4
            while rest.startswith("**/", pos):
                pos += 3
        elif rest[pos:] == "/**":
            out.append("/.*")
            pos += 3
        elif rest[pos] == "*":
            whole = rest == "**"
            out.append(".*" if whole else "[^/]*")
            while pos < len(rest) and rest[pos] == "*":
                pos += 1
        elif rest[pos] == "?":
            out.append("[^/]")
            pos += 1
        elif rest[pos] == "[" and "]" in rest[pos + 2:]:
            close = rest.index("]", pos + 2)
            inner = rest[pos + 1:close]
            negate = inner[:1] in ("!", "^")
            chars = re.sub(r"([\\\[\]&^])", r"\\\1", inner[1:] if negate else inner)
            out.append(f"[{'^/' if negate else ''}{chars}]")
            pos = close + 1
        elif rest[pos] == "{":
            depth += 1
            out.append("(?:")
            pos += 1
        elif rest[pos] == "}" and depth:
            depth -= 1
            out.append(")")
            pos += 1
        elif rest[pos] == "," and depth:
            out.append("|")
            pos += 1
        else:
            out.append(re.escape(rest[pos]).replace(r"\/", "/"))
            pos += 1
    return "".join(out)


@dataclass(frozen=True)
class PathGlob:
    """One compiled path pattern."""

    pattern: str
    body: str
    prefix: tuple[str, ...]

    @property
    def regex(self) -> str:
        return match_regex([self.body])


def match_regex(bodies: list[str]) -> str:
    """One regex for any of ``bodies`` on a normalised path; Windows paths ignore case.

    Patterns that may start at any component share one scan over the components.
    """
    floating = [b.removeprefix(_ANYWHERE) for b in bodies if b.startswith(_ANYWHERE)]
    rooted = [b for b in bodies if not b.startswith(_ANYWHERE)]
    either = "|".join(([f"{_ANYWHERE}(?:{'|'.join(floating)})"] if floating else []) + rooted)
    return rf"(?s)^/*+(?:{either})\z|^{_WINDOWS_HEAD}/*+(?i:{either})\z"


def glob_to_regex(pattern: str) -> tuple[str, str, str]:
    """(path regex, directory-root regex, case-insensitive regex for Windows paths).

    A pattern ending in ``/**`` also stands for the directory itself, which the
    second regex covers; for other patterns it is an expression that never matches.
    """
    body = _body(pattern)
    root = _body(pattern[:-3]) if pattern.endswith("/**") else r"[^\s\S]"
    return rf"(?s)^/*(?:{body})\z", rf"(?s)^/*(?:{root})\z", rf"(?is)^/*(?:{body}|{root})\z"


def compile_path(pattern: str) -> PathGlob:
    """Compile one pattern; raises ValueError for patterns a policy may not hold."""
    if not pattern or "\0" in pattern or pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError("path patterns must be relative and non-empty")
    body = _body(pattern)
    if pattern.endswith("/**"):
        body = _body(pattern[:-3]) + "(?:/.*)?"
    bare = pattern[3:] if pattern.startswith("**/") else pattern
    prefix = []
    for part in bare.split("/"):
        if re.search(r"[*?\[{]", part):
            break
        prefix.append(part)
    return PathGlob(pattern, body, tuple(prefix))


def tables_regex(plain: list[str], prefixed: list[str]) -> str:
    """One regex for many table globs, with one scan over the possible prefixes."""
    join = lambda names: "|".join(".*".join(re.escape(p) for p in n.split("*")) for n in names)
    return rf"(?is)^(?:(?:.*_)?(?:{join(prefixed)})|{join(plain)})\z"


def table_regex(pattern: str, prefixed: bool) -> str:
    """``*`` globs on table names; ``prefixed`` also allows a database prefix."""
    body = ".*".join(re.escape(part) for part in pattern.split("*"))
    return rf"(?is)^{'(?:.*_)?' if prefixed else ''}{body}\z"
