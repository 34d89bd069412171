"""Free-form JSON as a flat list of leaves inside the row."""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.sql import Sql
from warden.vocab import MAX_FRAME_DEPTH, MAX_JSON_DEPTH

_NODE = "struct<key:string,path:string,keys:array<string>,value:variant>"


def _children(node: Sql, numbered: bool = False) -> Sql:
    """The node's own children; a leaf stays as it is. Array items keep the key of the array.

    ``numbered`` writes the place of an item into its path and keeps empty objects and arrays.
    """
    as_map = F.try_variant_get(node["value"], "$", "map<string,variant>")
    as_list = F.try_variant_get(node["value"], "$", "array<variant>")
    inner = (lambda v: F.size(v) > 0) if numbered else (lambda v: v.isNotNull())
    item = lambda v, mark: F.struct(
        node["key"].alias("key"), F.concat(node["path"], mark).alias("path"), node["keys"].alias("keys"), v.alias("value"))
    return F.let(as_map, lambda m: F.when(
        inner(m),
        F.transform(F.map_entries(m), lambda e: F.struct(
            e["key"].alias("key"), F.concat(node["path"], "/", e["key"]).alias("path"),
            F.array_append(node["keys"], e["key"]).alias("keys"), e["value"].alias("value"))),
    ).otherwise(F.let(as_list, lambda a: F.when(
        inner(a),
        F.transform(a, lambda v, i: item(v, F.concat("[", i.cast("string"), "]"))) if numbered
        else F.transform(a, lambda v: item(v, "[]")),
    ).otherwise(F.array(node)))))


def nodes(value: Sql, depth: int = MAX_JSON_DEPTH, numbered: bool = False) -> Sql:
    """array<struct(key, path, keys, value)> of all leaves, opened level by level.

    What lies deeper than ``depth`` is left as it is, an object or array among the leaves.
    """
    start = F.expr(f"cast(array(named_struct('key', cast(null as string), 'path', '', 'keys', cast(array() as array<string>), 'value', {value}))"
                   f" as array<{_NODE}>)")
    return F.aggregate(F.sequence(1, depth), start, lambda level, _round: F.when(
        F.exists(level, _nested), F.flatten(F.transform(level, lambda node: _children(node, numbered))).cast(
            f"array<{_NODE}>")).otherwise(level))


def _nested(node: Sql) -> Sql:
    return F.schema_of_variant(node["value"]).rlike("^(?:OBJECT|ARRAY)<")


def opened(value: Sql) -> Sql:
    """All leaves as far down as the deepest frame that is accepted, with numbered array items and empty containers."""
    return nodes(value, MAX_FRAME_DEPTH, numbered=True)


def unopened(found: Sql) -> Sql:
    """Some leaf of ``opened`` still holds something: it lies deeper than any accepted frame."""
    return F.exists(found, lambda n: F.coalesce(
        F.size(F.try_variant_get(n["value"], "$", "map<string,variant>")) > 0,
        F.size(F.try_variant_get(n["value"], "$", "array<variant>")) > 0, F.lit(False)))


def too_deep(found: Sql) -> Sql:
    """Some value was deeper than the levels that were opened."""
    return F.exists(found, lambda n: F.schema_of_variant(n["value"]).rlike("^(?:OBJECT|ARRAY)<"))


def leaves(value: Sql, depth: int = MAX_JSON_DEPTH) -> Sql:
    """array<struct(key, path, text, is_null)>; ``text`` is NULL for leaves that are no strings."""
    return as_texts(nodes(value, depth))


def as_texts(found: Sql) -> Sql:
    return F.transform(found, lambda n: F.struct(
        n["key"].alias("key"), n["path"].alias("path"),
        F.when(F.schema_of_variant(n["value"]) == "STRING",
               F.try_variant_get(n["value"], "$", "string")).alias("text"),
        F.is_variant_null(n["value"]).alias("is_null")))


def texts_under(value: Sql, keys: tuple[str, ...], depth: int = MAX_JSON_DEPTH) -> Sql:
    """Every string found under one of ``keys``, whatever their case."""
    found = F.filter(leaves(value, depth), lambda n: F.lower(n["key"]).isin(*keys) & n["text"].isNotNull())
    return F.transform(found, lambda n: n["text"])
