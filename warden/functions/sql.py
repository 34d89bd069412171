"""Spark SQL expressions, put together as text.

The text and path functions are long expressions with many lambdas. Built from
``Column`` objects they cost tens of thousands of calls into the JVM, seconds
before a job even starts; as one SQL expression they are parsed in one call. An
``Sql`` is therefore just the text of a Spark SQL expression with the operators
of a column. ``col`` hands it to Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, functions as _functions

_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
_names = count()


class Sql:
    """The text of one Spark SQL expression."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _op(self, sign: str, other) -> Sql:
        return Sql(f"({self} {sign} {lit(other)})")

    def __add__(self, other): return self._op("+", other)
    def __sub__(self, other): return self._op("-", other)
    def __mul__(self, other): return self._op("*", other)
    def __mod__(self, other): return self._op("%", other)
    def __eq__(self, other): return self._op("=", other)  # type: ignore[override]
    def __ne__(self, other): return self._op("<>", other)  # type: ignore[override]
    def __lt__(self, other): return self._op("<", other)
    def __le__(self, other): return self._op("<=", other)
    def __gt__(self, other): return self._op(">", other)
    def __ge__(self, other): return self._op(">=", other)
    def __and__(self, other): return self._op("AND", other)
    def __or__(self, other): return self._op("OR", other)
    def __invert__(self): return Sql(f"(NOT {self})")
    __hash__ = object.__hash__

    def __getitem__(self, key: str) -> Sql:
        return Sql(f"{self}.`{key}`")

    def cast(self, kind: str) -> Sql: return Sql(f"cast({self} AS {kind})")
    def alias(self, name: str) -> Named: return Named(self, name)
    def rlike(self, regex) -> Sql: return self._op("RLIKE", regex)
    def isin(self, *values) -> Sql: return Sql(f"({self} IN ({', '.join(str(lit(v)) for v in values)}))")
    def isNull(self) -> Sql: return Sql(f"({self} IS NULL)")
    def isNotNull(self) -> Sql: return Sql(f"({self} IS NOT NULL)")
    def startswith(self, other) -> Sql: return call("startswith", self, other)
    def endswith(self, other) -> Sql: return call("endswith", self, other)
    def contains(self, other) -> Sql: return call("contains", self, other)
    def substr(self, at, size) -> Sql: return call("substring", self, at, size)


class Named:
    """An expression with the field name it gets inside a struct."""

    def __init__(self, value: Sql, name: str):
        self.value, self.name = value, name


class When(Sql):
    """CASE WHEN ladder."""

    def __init__(self, rungs: list):
        self.rungs = rungs
        super().__init__("")
        self.text = f"CASE {self._body()} END"

    def _body(self) -> str:
        return " ".join(f"WHEN {test} THEN {lit(value)}" for test, value in self.rungs)

    def when(self, test, value) -> When:
        return When([*self.rungs, (test, value)])

    def otherwise(self, value) -> Sql:
        return Sql(f"CASE {self._body()} ELSE {lit(value)} END")


def lit(value) -> Sql:
    if isinstance(value, Sql):
        return value
    if isinstance(value, bool):
        return Sql("true" if value else "false")
    if value is None:
        return Sql("null")
    if isinstance(value, (int, float)):
        return Sql(str(value))
    return Sql("'" + "".join(_ESCAPES.get(c, c) for c in value) + "'")


def _lambda(body: Callable) -> str:
    names = [f"v{next(_names)}" for _ in range(body.__code__.co_argcount)]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {lit(body(*[Sql(n) for n in names]))}"


def call(name: str, *args) -> Sql:
    parts = [_lambda(a) if callable(a) and not isinstance(a, Sql) else str(lit(a)) for a in args]
    return Sql(f"{name}({', '.join(parts)})")


def ref(name: str) -> Sql:
    """A column by name."""
    return Sql(".".join(f"`{part}`" for part in name.split(".")))


class fields:
    """The columns of a frame as the fields of one value."""

    def __init__(self, *names: str):
        self.names = names

    def __getitem__(self, name: str) -> Sql:
        if name not in self.names:
            raise KeyError(name)
        return ref(name)


def expr(text: str) -> Sql:
    return Sql(text)


def when(test, value) -> When:
    return When([(test, value)])


def struct(*fields: Named) -> Sql:
    return Sql("named_struct(" + ", ".join(f"'{f.name}', {lit(f.value)}" for f in fields) + ")")


def pairs(left: Named, right: Named) -> Sql:
    """Two arrays side by side as an array of structs."""
    return call(
        "zip_with", left.value, right.value, lambda a, b: struct(a.alias(left.name), b.alias(right.name))
    )


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body`` of a value that is computed once per row."""
    return Sql(f"get(transform(array({lit(value)}), {_lambda(body)}), 0)")


def let_as(kind: str, value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``let`` for a result of a known type.

    A fold hands its result on as it is; an element taken out of an array is copied, and
    its type is worked out anew from the whole expression for every row.
    """
    bound = _lambda(body)
    return Sql(f"aggregate(array({lit(value)}), cast(null AS {kind}), (_, {bound.replace(' -> ', ') -> ', 1)})")


def any_of(text: Sql, words) -> Sql:
    """The text holds one of ``words``: a byte search, far cheaper than a regex."""
    return Sql("(" + " OR ".join(str(text.contains(word)) for word in sorted(set(words))) + ")")


def col(value: Sql | str) -> Column:
    """The expression as a Spark column."""
    return _functions.expr(str(value))


def __getattr__(name: str):
    """Every other name is the Spark SQL function of that name."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)
