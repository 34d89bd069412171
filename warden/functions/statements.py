"""Words and statements of logged SQL text."""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.decisions import DECISION, decision, none
from warden.functions.globs import tables_regex
from warden.functions.sql import Sql
from warden.vocab import (
    CATEGORIES, MAX_STRING_BYTES, SENSITIVE_TABLES, SQL_FILE_WORDS, SQL_MUTATIONS, SQL_READERS, SQL_SAFE_CALLS,
    TABLE_SOURCE_CATEGORIES, UNPREFIXED_TABLES,
)

_STRING = r"'(?:[^'\\]|'')*+'"
_QUOTED = r'"(?:[^"\\]|"")*+"|`(?:[^`\\]|``)*+`'
_COMMENT = r"#[^\n]*+|--(?=[\s\x00-\x1f\x7f]|\z)[^\n]*+|/\*(?!!|M!).*?\*/"
_PIECE = rf"(?s){_STRING}|{_QUOTED}|{_COMMENT}|[().;]|[A-Za-z0-9_]++"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(sql: Sql) -> Sql:
    """Upper-case words and ``( ) . ;`` marks; NULL where the text is ambiguous.

    Whatever no piece of the grammar took is looked at afterwards: a quote,
    a backslash or a comment start left over means the text cannot be read.
    """
    rest = F.regexp_replace(sql, _PIECE, " ")
    ambiguous = rest.rlike(r"""['"`\\]|/\*""")
    pieces = F.regexp_extract_all(sql, _PIECE, 0)
    kept = F.filter(pieces, lambda p: ~p.rlike(r"(?s)^(?:'|#|--|/\*)"))
    plain = F.transform(kept, lambda p: F.translate(
        F.when(p.startswith('"'), F.replace(p.substr(2, F.length(p) - 2), '""', ""))
        .when(p.startswith("`"), F.replace(p.substr(2, F.length(p) - 2), "``", ""))
        .otherwise(p), _LOWER, _UPPER))
    return F.when(~ambiguous, F.filter(plain, lambda w: w != ""))


def inspectable(sql: Sql) -> Sql:
    return (F.octet_length(sql) <= MAX_STRING_BYTES) & ~F.contains(sql, "\0")


def _identifier(word: Sql) -> Sql:
    return F.lower(F.regexp_replace(word, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+\z", ""))


def sensitive_regex(configured: tuple[str, ...] = ()) -> str:
    """One regex for every sensitive table name, with and without a database prefix."""
    prefixed = [t for t in SENSITIVE_TABLES if t not in UNPREFIXED_TABLES]
    return tables_regex(list(UNPREFIXED_TABLES), [*prefixed, *configured])


def _split_statements(found: Sql) -> Sql:
    ends = F.filter(F.transform(found, lambda w, i: F.when(w == ";", i)), lambda i: i.isNotNull())
    return F.let_as("array<array<string>>", ends, lambda e: F.zip_with(
        F.concat(F.array(-1), e), F.concat(e, F.array(F.size(found))),
        lambda a, b: F.slice(found, a + 2, b - a - 1)))


def statements(sql: Sql) -> Sql:
    """Statements of one query as word arrays; NULL where the text is ambiguous."""
    return F.let_as("array<array<string>>", words(sql), lambda w: F.when(w.isNotNull(), _split_statements(w)))


def ambiguous() -> Sql:
    return decision("deny", "sql.ambiguous", "high", "sql")


def statement_decision(statement: Sql, configured: tuple[str, ...] = ()) -> Sql:
    """P13 on one statement: the first test that holds decides."""
    mutations = F.filter(
        F.expr("array(" + ", ".join(f"'{m}'" for m in SQL_MUTATIONS) + ")"),
        lambda m: F.array_contains(statement, m))
    first = F.get(statement, 0)
    calls = F.exists(
        F.transform(statement, lambda w, i: (F.get(statement, i + 1) == "(") & w.rlike("[A-Za-z]") & (
            ~w.isin(*SQL_SAFE_CALLS) | F.coalesce(F.get(statement, i - 1) == ".", F.lit(False)))),
        lambda c: F.coalesce(c, F.lit(False)))
    sensitive = F.exists(statement, lambda w: _identifier(w).rlike(sensitive_regex(configured)))
    return (
        F.when(F.size(mutations) > 0,
               decision("deny", F.concat(F.lit("sql.mutation."), F.lower(F.get(mutations, 0))), "critical", "sql"))
        .when(F.exists(statement, lambda w: w.isin(*SQL_FILE_WORDS)),
              decision("deny", "sql.filesystem_access", "critical", "sql"))
        .when(calls, decision("deny", "sql.function.unknown", "high", "sql"))
        .when((F.size(statement) > 0) & ~first.isin(*SQL_READERS), ambiguous())
        .when((F.size(statement) > 0) & sensitive, decision("deny", "sql.read.sensitive_table", "high", "sql"))
        .otherwise(none())
    )


def query_decision(sql: Sql, configured: tuple[str, ...] = ()) -> Sql:
    """P13 on a whole query: the first statement that decides, NULL for a harmless read."""
    first = F.let_as(DECISION, statements(sql), lambda s: F.when(s.isNull(), ambiguous()).otherwise(
        F.get(F.filter(F.transform(s, lambda st: statement_decision(st, configured)), lambda d: d.isNotNull()), 0)))
    return F.when(
        F.regexp_replace(sql, r"[\p{IsWhite_Space}]+", "") == "", ambiguous()
    ).when(~inspectable(sql), ambiguous()).otherwise(first).cast(DECISION)


def sensitive_tables(sql: Sql, configured: tuple[str, ...] = ()) -> Sql:
    """Distinct sensitive identifiers of a query, in order; NULL where it is ambiguous."""
    regex = sensitive_regex(configured)
    return F.when(inspectable(sql), F.let_as("array<string>", words(sql), lambda w: F.when(w.isNotNull(), F.array_distinct(
        F.filter(F.transform(w, _identifier), lambda t: (t != "") & t.rlike(regex))))))


def table_categories(table: Sql) -> Sql:
    """What reading a table exposes, by the shortest known ending of its name."""
    known = [w for words_, _ in TABLE_SOURCE_CATEGORIES for w in words_]
    places = F.filter(
        F.array(*[F.instr(table, w) for w in known]), lambda p: p > 0)
    ending = F.when(F.size(places) > 0, table.substr(F.array_max(places), F.length(table))).otherwise(table)

    def ladder(name: Sql) -> Sql:
        out = None
        for words_, categories in TABLE_SOURCE_CATEGORIES:
            value = F.array(*[F.lit(c) for c in CATEGORIES if c in categories])
            for word in words_:
                exact = word in ("sessions", "flood", "watchdog")
                test = (name == word) if exact else name.startswith(word)
                if word == "key_value":
                    test = name.isin("key_value", "key_value_expire")
                out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(F.array("unknown_sensitive"))

    return F.let_as("array<string>", ending, ladder)
