"""Masking driven by the schema of any DataFrame (F17, F18 on typed data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from warden.functions import sql as S
from warden.functions.detectors import detect
from warden.functions.fields import ScanConfig, field_category, static_category
from warden.functions.spans import merge, placeholder_of, redact
from warden.functions.sql import Sql
from warden.sources.audit_lake import known, pseudonymize  # noqa: F401  (public names)
from warden.vocab import placeholder


def scanned(text: Sql, config: ScanConfig) -> Sql:
    """A text with its findings replaced."""
    return S.let(merge(detect(text, config)), lambda m: redact(text, m))


def _fields(value: Sql, kind: T.StructType, cover) -> Sql:
    parts = [cover(f, value[f.name]) for f in kind.fields]
    return S.when(value.isNotNull(), S.struct(*[part.alias(name) for name, part in parts]))


def covered(value: Sql, kind: T.DataType, mark: Sql, name: str | None = None) -> Sql:
    """Every leaf replaced by ``mark``; NULL stays NULL. Nested keys become ``<mark>:keyN`` by their sorted place."""
    if isinstance(kind, T.ArrayType):
        return S.transform(value, lambda v: covered(v, kind.elementType, mark, name))
    if isinstance(kind, T.StructType):
        place = {n: i for i, n in enumerate(sorted(kind.names))}
        return _fields(value, kind, lambda f, v: (
            f"{name}:key{place[f.name]}" if name else f.name, covered(v, f.dataType, mark, name)))
    if isinstance(kind, T.MapType):
        entries = S.array_sort(S.map_keys(value))
        return S.let(entries, lambda keys: S.map_from_arrays(
            S.transform(keys, lambda _k, i: S.concat(mark, S.lit(":key"), i.cast("string"))),
            S.transform(keys, lambda k: covered(S.Sql(f"{value}[{k}]"), kind.valueType, mark, name))))
    return S.when(value.isNotNull(), mark)


def masked(value: Sql, kind: T.DataType, config: ScanConfig) -> Sql:
    """Sensitive names masked, other texts scanned, the rest as it is."""
    if isinstance(kind, T.StringType):
        return scanned(value, config)
    if isinstance(kind, T.ArrayType):
        return S.transform(value, lambda v: masked(v, kind.elementType, config))
    if isinstance(kind, T.StructType):
        return _fields(value, kind, lambda f, v: (f.name, named(f.name, v, f.dataType, config)))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _map(value, kind, config)
    return value


def named(name: str, value: Sql, kind: T.DataType, config: ScanConfig) -> Sql:
    """A value under a name: the name decides, an array passes its name on to its items."""
    category = static_category(name, config)
    if category is None:
        return masked(value, kind, config)
    mark = placeholder(category)
    return covered(value, kind, S.lit(mark), mark)


def _as_text(value: Sql, kind: T.DataType, config: ScanConfig) -> Sql:
    if isinstance(kind, T.ArrayType):
        return S.transform(value, lambda v: _as_text(v, kind.elementType, config))
    if isinstance(kind, T.StructType):
        return _fields(value, kind, lambda f, v: (f.name, _as_text(v, f.dataType, config)))
    if isinstance(kind, T.StringType):
        return scanned(value, config)
    return value.cast("string")


def _map(value: Sql, kind: T.MapType, config: ScanConfig) -> Sql:
    """Keys are data: each decides about its value and is itself scanned. Keys that collide once
    redacted leave no map. Values are texts afterwards, since any of them may become a placeholder."""
    keys = S.map_keys(value)
    safe = S.transform(keys, lambda k: scanned(k, config))
    values = S.transform(S.map_entries(value), lambda e: S.let(
        field_category(e["key"], config),
        lambda c: S.when(c.isNotNull(), covered(e["value"], kind.valueType, placeholder_of(c))).otherwise(
            _as_text(e["value"], kind.valueType, config))))
    return S.let(safe, lambda s: S.when(
        S.size(S.array_distinct(s)) == S.size(s), S.map_from_arrays(s, values)))


def mask_columns(df: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """one projection over any schema, nested or not."""
    return df.select(*[
        S.col(named(f.name, S.ref(f"{f.name}"), f.dataType, config)).alias(f.name) for f in df.schema.fields])


def mask_all(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """every value of a source known to be sensitive, but for the columns to keep."""
    mark = placeholder("unknown_sensitive")
    return df.select(*[
        S.col(S.ref(f.name) if f.name in keep else covered(S.ref(f.name), f.dataType, S.lit(mark), mark)).alias(f.name)
        for f in df.schema.fields])
