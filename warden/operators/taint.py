"""Taint of sessions: which kinds of sensitive data a session touched, and where it then sent data.

Taint never shrinks, so what a session knew before a call follows from the first
moment each category appeared. That is one small row per session, found by an
aggregation that combines map-side; no window ever gathers a whole session, and
the join back splits a hot session at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from warden.functions import sql as S
from warden.functions.calls import is_mcp
from warden.functions.decisions import RuleSet, first_rule_id, rank
from warden.functions.paths import normalize
from warden.functions.sql import Sql
from warden.functions.statements import sensitive_tables, table_categories
from warden.vocab import CATEGORIES, MAX_SOURCES, PATH_SOURCE_CATEGORIES

KEY = ("agent", "session_id")
_STRINGS = "cast(array() as array<string>)"


def order_key(ts: str = "ts", seq: str = "seq") -> Column:
    """(ts, seq) as one decimal: it compares in order and aggregates without sorting rows."""
    return F.expr(
        f"cast(unix_micros(cast({ts} as timestamp)) as decimal(38,0)) * cast(10000000000000000000 as decimal(20,0))"
        f" + cast({seq} as decimal(38,0))").cast("decimal(38,0)")


def path_source(path: Sql, rules: RuleSet = RuleSet(), project: Sql | None = None) -> Sql:
    """The source id of a protected path, by the rules that guard reads, those of the call's project included."""
    layers = ("built_in", "organization", "project")
    return first_rule_id(path, [r for layer in layers for r in rules.of(layer, "read")], project)


def _project(calls: DataFrame) -> Sql | None:
    return S.ref("project") if "project" in calls.columns else None


def source_categories(source_id: Sql) -> Sql:
    ladder = None
    for known, categories in PATH_SOURCE_CATEGORIES.items():
        value = S.array(*categories)
        ladder = S.when(source_id == known, value) if ladder is None else ladder.when(source_id == known, value)
    return ladder.otherwise(S.array("unknown_sensitive"))


def pseudonym(value: Sql) -> Sql:
    """F19."""
    return S.concat(S.lit("sha256:"), S.sha2(value, 256))


def sources(calls: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """One row per sensitive source a call touches.

    ``calls`` has call_id, cwd, paths (array) and sql_texts (array); resources leave
    this function as pseudonyms only.
    """
    paths = S.transform(S.ref("paths"), lambda p: S.let(normalize(S.ref("cwd"), p), lambda n: S.let(
        path_source(n, rules, _project(calls)), lambda source: S.when(source.isNotNull(), S.struct(
            source.alias("source_id"), S.lit("file").alias("resource_kind"), pseudonym(n).alias("resource"),
            source_categories(source).alias("categories"))))))
    texts = S.transform(S.ref("sql_texts"), lambda q: S.transform(
        S.coalesce(sensitive_tables(q, rules.tables), S.expr(_STRINGS)), lambda t: S.struct(
            S.lit("sql.read.sensitive_table").alias("source_id"), S.lit("sql_table").alias("resource_kind"),
            pseudonym(t).alias("resource"), table_categories(t).alias("categories"))))
    found = S.array_distinct(S.filter(S.concat(paths, S.flatten(texts)), lambda s: s.isNotNull()))
    keep = [c for c in calls.columns if c not in ("paths", "sql_texts", "cwd")]
    return calls.select(*keep, F.explode_outer(S.col(found)).alias("s")).where("s is not null").select(*keep, "s.*")


def call_categories(calls: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """The categories that each call exposes, kept in the row as ``source_categories``.

    Sources are the paths of the call and, where the columns are there, its ``queries`` (of MCP and unknown tools) and
    what its commands show (``shown``, see commands.with_flow).
    """
    project = _project(calls)
    paths = S.transform(S.ref("paths"), lambda p: normalize(S.ref("cwd"), p))
    texts = S.expr(_STRINGS)
    if "queries" in calls.columns:
        kind = S.ref("capability")
        texts = S.when(is_mcp(S.ref("tool_name"), kind) | (kind == "unknown"), S.ref("queries")).otherwise(texts)
    if "shown" in calls.columns:
        paths, texts = S.concat(paths, S.ref("shown")["paths"]), S.concat(texts, S.ref("shown")["sql"])
    of_path = lambda p: S.let_as("array<string>", path_source(p, rules, project), lambda source: S.when(
        source.isNotNull(), source_categories(source)).otherwise(S.expr(_STRINGS)))
    of_text = lambda q: S.flatten(S.transform(
        S.coalesce(sensitive_tables(q, rules.tables), S.expr(_STRINGS)), table_categories))
    staged = calls.withColumn("_of_paths", S.col(S.flatten(S.transform(paths, of_path)))).withColumn(
        "_of_texts", S.col(S.flatten(S.transform(texts, of_text))))
    return staged.withColumn("source_categories", F.array_distinct(F.concat("_of_paths", "_of_texts"))).drop(
        "_of_paths", "_of_texts")


def first_seen(events: DataFrame) -> DataFrame:
    """Per session: the first moment of every category; sessions that stayed clean are left out."""
    marks = [
        F.min(F.when(F.array_contains("source_categories", c), F.col("_order"))).alias(f"first_{c}")
        for c in CATEGORIES
    ]
    firsts = events.withColumn("_order", order_key()).where("session_id is not null").groupBy(*KEY).agg(*marks)
    return firsts.where(" or ".join(f"first_{c} is not null" for c in CATEGORIES))


def prior(events: DataFrame) -> DataFrame:
    """Every event with ``prior``, the categories its session had touched before it."""
    firsts = first_seen(events)
    joined = events.withColumn("_order", order_key()).join(firsts, list(KEY), "left")
    known = F.filter(
        F.array(*[F.when(F.col(f"first_{c}") < F.col("_order"), F.lit(c)) for c in CATEGORIES]),
        lambda c: c.isNotNull())
    return joined.withColumn("prior", known).drop("_order", *[f"first_{c}" for c in CATEGORIES])


def enforce(events: DataFrame) -> DataFrame:
    """The taint decision replaces the stateless one only where it is strictly stronger.

    ``events`` has prior (array), sink, effect and rule_id.
    """
    hot = (F.size("prior") > 0) & F.col("sink").isNotNull()
    grave = F.size(F.array_remove("prior", "operational_sensitive")) > 0
    effect = F.when(hot, F.when(grave, F.lit("deny")).otherwise(F.lit("ask")))
    rule = F.when(grave, F.lit("exfiltration.tainted_session")).otherwise(F.lit("exfiltration.tainted_session.review"))
    stronger = F.coalesce(
        S.col(rank(S.ref("_taint_effect"))) > S.col(rank(S.ref("effect"))), F.lit(False))
    return (
        events.withColumn("_taint_effect", effect)
        .withColumn("enforced_effect", F.when(stronger, F.col("_taint_effect")).otherwise(F.col("effect")))
        .withColumn("enforced_rule_id", F.when(stronger, rule).otherwise(F.col("rule_id")))
        .drop("_taint_effect"))


def distances(events: DataFrame) -> DataFrame:
    """Per tainted session the first taint, the first outbound call after it and the calls between."""
    marked = events.withColumn("_order", order_key())
    firsts = first_seen(events).select(
        *KEY, F.array_min(F.array(*[f"first_{c}" for c in CATEGORIES])).alias("taint_order"))
    joined = marked.join(firsts, list(KEY))
    outbound = joined.where("sink is not null and _order > taint_order").groupBy(*KEY).agg(
        F.min("_order").alias("out_order"))
    return (
        joined.join(outbound, list(KEY), "left").groupBy(*KEY)
        .agg(
            F.min(F.when(F.col("_order") == F.col("taint_order"), F.col("call_id"))).alias("taint_call"),
            F.min(F.when(F.col("_order") == F.col("out_order"), F.col("call_id"))).alias("outbound_call"),
            F.count_if((F.col("_order") > F.col("taint_order")) & (F.col("_order") <= F.col("out_order"))).alias("calls_between"),
        ))


def distinct_sources(found: DataFrame) -> DataFrame:
    """Sources of a session without repeats, with the first time each was seen."""
    return (
        found.withColumn("_order", order_key())
        .groupBy(*KEY, "source_id", "resource_kind", "resource")
        .agg(
            F.min("_order").alias("first_order"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            *[F.max(F.array_contains("categories", c)).alias(f"has_{c}") for c in CATEGORIES]))


def sessions(found: DataFrame) -> DataFrame:
    """One row per session with its categories and its last 32 distinct sources.

    The cut to 32 runs per input partition first, so a session with millions of
    sources sends 32 of them. It is exact while no evicted source comes back.
    """
    known = distinct_sources(found)
    totals = known.groupBy(*KEY).agg(
        F.min("first_ts").alias("created_ts"), F.max("last_ts").alias("updated_ts"),
        F.count("*").alias("n_sources"), *[F.max(f"has_{c}").alias(f"has_{c}") for c in CATEGORIES])
    latest = (
        known.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(
            F.desc("first_order"), "source_id", "resource")))
        .where(F.col("_n") <= MAX_SOURCES).groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("first_order", "source_id", "resource_kind", "resource"))).alias("sources")))
    categories = F.filter(
        F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in CATEGORIES]), lambda c: c.isNotNull())
    return totals.join(latest, list(KEY)).select(
        *KEY, "created_ts", "updated_ts", categories.alias("categories"), "n_sources", "sources")


def integrity(found: DataFrame, rolled: DataFrame) -> DataFrame:
    """Sources whose categories are not part of their session's; none may exist."""
    return found.join(rolled.select(*KEY, F.col("categories").alias("session_categories")), list(KEY)).where(
        F.size(F.array_except("categories", "session_categories")) > 0)
