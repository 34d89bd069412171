"""Query-log audit: statements, verdicts and sensitive tables of logged SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.statements import query_decision, sensitive_tables, statements as split, table_categories


def statements(queries: DataFrame, text: str = "query", id_: str = "call_id") -> DataFrame:
    """One row per statement; a text that cannot be read gives one row with NULL words."""
    found = S.let(split(S.ref(text)), lambda s: S.when(s.isNotNull(), s).otherwise(
        S.expr("array(cast(null as array<string>))")))
    return queries.select(id_, F.posexplode_outer(S.col(found)).alias("stmt_pos", "words"))


def verdicts(queries: DataFrame, tables: tuple[str, ...] = (), text: str = "query", id_: str = "call_id") -> DataFrame:
    """Effect and rule of every query; harmless reads are allowed without a rule."""
    staged = queries.withColumn("_d", S.col(query_decision(S.ref(text), tables)))
    return staged.select(
        id_, F.coalesce("_d.effect", F.lit("allow")).alias("effect"),
        F.coalesce("_d.rule_id", F.lit("none")).alias("rule_id"))


def sources(queries: DataFrame, tables: tuple[str, ...] = (), text: str = "query", id_: str = "call_id") -> DataFrame:
    """One row per sensitive table of a query with the categories it exposes."""
    found = S.coalesce(sensitive_tables(S.ref(text), tables), S.expr("cast(array() as array<string>)"))
    return (
        queries.select(id_, F.explode_outer(S.col(found)).alias("table_name"))
        .where("table_name is not null")
        .select(id_, "table_name", S.col(table_categories(S.ref("table_name"))).alias("categories")))
