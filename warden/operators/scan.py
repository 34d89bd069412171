"""Sensitive-data scan of a corpus: findings, verdicts and redacted text.

The whole scan is one projection over the corpus: spans live in an array next to
their text, so nothing is shuffled. Only reports over findings group rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.detectors import CARD_DIGITS, SEPARATOR_LINE, detect, open_context, payment_cards
from warden.functions.fields import SPACE, ScanConfig, field_class, trim
from warden.functions.spans import SPAN, blanked, fixed_span, merge, no_spans, redact
from warden.functions.sql import Sql
from warden.functions.variants import as_texts, nodes, too_deep
from warden.vocab import (
    CATEGORIES, CATEGORY_RANK, MAX_FINDINGS, MAX_LINE_DELIMITERS, MAX_NEWLINES, MAX_SCAN_BYTES,
)

#: log2 of the buckets of a sketch of texts; 14 takes at most about 16 KB.
SKETCH_PRECISION = 14


def spans(text: Sql | str, config: ScanConfig = ScanConfig()):
    """Unmerged spans of a text column, as a Spark column."""
    return S.col(detect(S.ref(text) if isinstance(text, str) else text, config))


def ordered_categories(values: Sql) -> Sql:
    """Distinct categories in contract order."""
    return S.filter(
        S.array(*[S.lit(c) for c in CATEGORIES]), lambda c: S.array_contains(values, c)
    )


def limit_rule(text: Sql, valid: Sql | None = None) -> Sql:
    """The rule of a text no scan may accept, else NULL.

    The line test only runs for texts long enough to fail it.
    """
    newlines = S.length(text) - S.length(S.replace(text, "\n", ""))
    wide = S.exists(S.split(text, "\n", -1), lambda line: (
        S.length(line) - S.length(S.translate(line, "|\t", "")) > MAX_LINE_DELIMITERS))
    rule = S.when(S.octet_length(text) > MAX_SCAN_BYTES, "result.scan_limit")
    if valid is not None:
        rule = rule.when(~valid, "result.unsupported_encoding")
    rule = rule.when(newlines > MAX_NEWLINES, "result.structure_limit")
    return rule.when(
        (S.octet_length(text) > MAX_LINE_DELIMITERS)
        & (S.contains(text, "|") | S.contains(text, "\t")) & wide,
        "result.structure_limit",
    )


def looks_like_json(text: Sql) -> Sql:
    return text.rlike(r'^\s*+[{\["]')


def _scanned(df: DataFrame, text: str, config: ScanConfig) -> DataFrame:
    """Adds ``_rule`` (why the text is blocked, or NULL) and ``_spans`` (merged, with raw count)."""
    t = S.ref(text)
    df = df.withColumn("_limit", S.col(limit_rule(t)))
    raw = S.ref("_raw")
    df = df.withColumn("_raw", S.col(S.when(~looks_like_json(t), detect(t, config))))
    # Cards whose run of digits goes on into another span show once that span is taken out.
    beside = S.let_as(f"array<{SPAN}>", blanked(t, merge(raw)), payment_cards)
    df = df.withColumn("_raw", S.col(S.when(
        (S.size(raw) > 0) & t.rlike(CARD_DIGITS), S.concat(raw, beside)).otherwise(raw)))
    found = S.when(raw.isNotNull(), S.struct(S.size(raw).alias("raw"), merge(raw).alias("merged")))
    return df.withColumn("_found", S.col(found))


def findings(df: DataFrame, text: str, id_: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Merged findings of plain texts, one row each, with character and byte offsets.

    All findings of every text: the limits that make a verdict ``block`` take nothing away here.
    """
    t = S.ref(text)
    return (
        _scanned(df, text, config)
        .select(F.col(id_), F.col(text), F.explode_outer("_found.merged").alias("s"))
        .where(F.col("s").isNotNull())
        .select(
            id_,
            F.col("s.detector").alias("detector_id"),
            F.col("s.category").alias("category"),
            F.col("s.confidence").alias("confidence"),
            F.col("s.start").alias("start_char"),
            F.col("s.end").alias("end_char"),
            S.col(S.octet_length(t.substr(1, S.expr("s.start")))).alias("start_byte"),
            S.col(S.octet_length(t.substr(1, S.expr("s.`end`")))).alias("end_byte"),
        )
    )


def verdicts(df: DataFrame, text: str, id_: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Allow, sanitize or block per text, with redacted content.

    Texts that look like JSON are judged by their leaves; content of a JSON text
    that needs rewriting is not released, since only typed data is rewritten (F17).
    ``content`` is what the verdict releases, NULL if it blocks. ``n_findings`` and
    ``redacted``, the text without any of its findings (NULL for JSON), are complete
    whatever the verdict, also beyond the cap of findings.
    """
    t, found = S.ref(text), S.ref("_found")
    scanned = _scanned(df, text, config).withColumn(
        "_json", S.col(S.when(S.ref("_limit").isNull() & looks_like_json(t), json_verdict(t, config)))
    )
    capped = found["raw"] > MAX_FINDINGS
    rule = (
        S.when(S.ref("_limit").isNotNull(), S.ref("_limit"))
        .when(looks_like_json(t), S.ref("_json")["rule"])
        .when(capped, "result.finding_limit")
        .when(S.size(found["merged"]) > 0, "result.sensitive_output")
        .otherwise("result.clean")
    )
    out = scanned.withColumn("rule_id", S.col(rule))
    r = S.ref("rule_id")
    decision = S.when(r == "result.clean", "allow").when(r == "result.sensitive_output", "sanitize").otherwise("block")
    categories = (
        S.when(decision == "block", S.array("unknown_sensitive"))
        .when(looks_like_json(t), S.ref("_json")["categories"])
        .otherwise(ordered_categories(S.transform(found["merged"], lambda s: s["category"])))
    )
    content = S.when(decision == "allow", t).when(
        (decision == "sanitize") & ~looks_like_json(t), redact(t, found["merged"])
    )
    n = S.when(looks_like_json(t), S.ref("_json")["n"]).otherwise(S.size(found["merged"]))
    return out.select(
        id_,
        S.col(decision).alias("decision"),
        "rule_id",
        S.col(S.coalesce(categories, S.expr("cast(array() as array<string>)"))).alias("categories"),
        S.col(S.coalesce(n, S.lit(0))).alias("n_findings"),
        S.col(content).alias("content"),
        S.col(S.when(~looks_like_json(t), redact(t, found["merged"]))).alias("redacted"),
    )


MAX_SCAN_DEPTH = 32


def json_verdict(text: Sql, config: ScanConfig = ScanConfig(), depth: int = MAX_SCAN_DEPTH) -> Sql:
    """struct(rule, categories, n) of a JSON text, from its leaves and keys."""
    def leaf_hits(leaf: Sql) -> Sql:
        kind = field_class(leaf["key"], config)
        word = S.when(leaf["text"].isNotNull(), merge(detect(leaf["text"], config)))
        return S.let(kind, lambda k: S.when(
            k.isNotNull(),
            S.when(leaf["is_null"], S.expr("cast(array() as array<string>)")).otherwise(S.array(k["category"])),
        ).otherwise(S.coalesce(
            S.transform(word, lambda s: s["category"]), S.expr("cast(array() as array<string>)"))))

    def in_keys(found: Sql) -> Sql:
        keys = S.array_distinct(S.flatten(S.transform(found, lambda n: n["keys"])))
        return S.flatten(S.transform(keys, lambda k: S.transform(merge(detect(k, config)), lambda s: s["category"])))

    def judged(found: Sql) -> Sql:
        categories = S.concat(S.flatten(S.transform(as_texts(found), leaf_hits)), in_keys(found))
        return S.let(categories, lambda c: S.struct(
            S.when((S.size(c) > MAX_FINDINGS) | too_deep(found), "result.sanitization_error")
            .when(S.size(c) > 0, "result.sensitive_output").otherwise("result.clean").alias("rule"),
            ordered_categories(c).alias("categories"), S.size(c).alias("n")))

    broken = S.struct(
        S.lit("result.sanitization_error").alias("rule"),
        S.expr("cast(array() as array<string>)").alias("categories"), S.lit(0).alias("n"))
    return S.let(S.try_parse_json(text), lambda v: S.when(v.isNull(), broken).otherwise(
        S.let(nodes(v, depth), judged)))


def detector_report(found: DataFrame, id_: str, approximate: bool = False) -> DataFrame:
    """Findings and distinct texts per detector.

    Counts are merged per (detector, text) first, so a text or detector that holds
    most findings is reduced before it travels.
    """
    if approximate:
        return found.groupBy("detector_id", "category").agg(
            F.count("*").alias("n_findings"), F.approx_count_distinct(id_).alias("n_docs"))
    per_text = found.groupBy("detector_id", "category", id_).agg(F.count("*").alias("n"))
    return per_text.groupBy("detector_id", "category").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_docs"))


def detector_sketches(found: DataFrame, id_: str, by: list[str], precision: int = SKETCH_PRECISION) -> DataFrame:
    """One row per detector and value of ``by`` (a day, say) with its findings and a mergeable sketch of its texts.

    Findings meet the sketches before they travel, so a shuffle carries one sketch of fixed size per group and
    partition, however many texts a detector has. Rows of later days are added to those kept, never made anew.
    """
    return found.groupBy("detector_id", "category", *by).agg(
        F.count("*").alias("n_findings"), F.hll_sketch_agg(id_, precision).alias("texts"))


def sketch_report(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``detector_sketches`` merged per detector and ``by``; n_docs is an estimate.

    A text found on several days counts once. The standard error is about 1.04 / sqrt(2 ** precision): 0.8 % here.
    """
    return sketches.groupBy("detector_id", "category", *(by or [])).agg(
        F.sum("n_findings").alias("n_findings"),
        F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("n_docs"))


def top_texts(found: DataFrame, id_: str, n: int = 20) -> DataFrame:
    """O2: the n texts with most findings; a bounded top-n, never a global sort."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(r)) for c, r in CATEGORY_RANK.items()])
    return (
        found.groupBy(id_)
        .agg(F.count("*").alias("n_findings"), F.max(rank).alias("top_rank"))
        .orderBy(F.desc("n_findings"), F.desc("top_rank"), id_)
        .limit(n)
    )


def two_stream_verdicts(df: DataFrame, id_: str, first: str, second: str,
                        config: ScanConfig = ScanConfig()) -> DataFrame:
    """One verdict for the two output streams of a call, kept as two columns of a row."""
    a, b = S.ref(first), S.ref(second)
    # Both streams pass through one expression, as items of an array.
    judged = S.transform(S.array(a, b), lambda t: S.struct(
        stream_rule(t, config).alias("rule"), open_context(t, config).alias("open")))
    flagged = df.withColumn("_j", S.col(judged))
    x, y = S.expr("_j[0].rule"), S.expr("_j[1].rule")
    opened = ((b != "") & S.expr("_j[0].open")) | ((a != "") & S.expr("_j[1].open"))
    quiet = ("result.clean", "result.sensitive_output")
    rule = (
        S.when((x == "result.scan_limit") | (y == "result.scan_limit"), "result.scan_limit")
        .when(opened, "result.cross_stream_context")
        .when(~x.isin(*quiet) | ~y.isin(*quiet), "result.inspection_failed")
        .when((x == "result.sensitive_output") | (y == "result.sensitive_output"), "result.sensitive_output")
        .otherwise("result.clean")
    )
    done = flagged.withColumn("rule_id", S.col(rule))
    r = S.ref("rule_id")
    return done.select(
        id_,
        S.col(S.when(r == "result.clean", "allow").when(r == "result.sensitive_output", "sanitize")
              .otherwise("block")).alias("decision"),
        "rule_id",
    )


def stream_rule(text: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    """The rule of one text without its content."""
    plain = S.let(S.size(detect(text, config)), lambda n: S.when(n > MAX_FINDINGS, "result.finding_limit")
                  .when(n > 0, "result.sensitive_output").otherwise("result.clean"))
    return S.let(limit_rule(text), lambda limit: S.when(limit.isNotNull(), limit).when(
        looks_like_json(text), json_verdict(text, config)["rule"]).otherwise(plain))


def _line_spans(text: Sql) -> Sql:
    """Every value below the header of a text table, as spans."""
    lines = S.aggregate(
        S.split(text, "\n", -1),
        S.struct(S.lit(0).alias("pos"), S.expr("cast(array() as array<struct<at:int,line:string>>)").alias("out")),
        lambda acc, raw: S.struct(
            (acc["pos"] + S.length(raw) + 1).alias("pos"),
            S.array_append(acc["out"], S.struct(
                acc["pos"].alias("at"), S.regexp_replace(raw, r"\r+\z", "").alias("line"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    whole = lambda at, part: fixed_span(
        at + S.length(S.regexp_extract(part, rf"^{SPACE}*", 0)),
        at + S.length(S.regexp_replace(part, rf"{SPACE}+\z", "")),
        len(CATEGORIES) + 20, "unknown_sensitive", "source.sensitive_value")

    def cells(row: Sql, delimiter: Sql) -> Sql:
        parts = S.when(delimiter == "|", S.split(row["line"], r"\|", -1)).otherwise(S.split(row["line"], "\t", -1))
        return S.aggregate(
            parts, S.struct(row["at"].alias("pos"), no_spans().alias("out")),
            lambda acc, c: S.struct((acc["pos"] + S.length(c) + 1).alias("pos"),
                                    S.array_append(acc["out"], whole(acc["pos"], c)).alias("out")),
            lambda acc: acc["out"])

    def built(rows: Sql) -> Sql:
        marks = S.transform(rows, lambda r: r["line"].rlike(r"[|\t]"))
        head = S.array_position(marks, True).cast("int")
        after = S.filter(S.slice(rows, head + 1, S.size(rows)), lambda r: trim(r["line"]) != "")
        ruled = S.coalesce(S.get(after, 0)["line"].rlike(SEPARATOR_LINE), S.lit(False))
        delimiter = S.when(S.contains(S.get(rows, head - 1)["line"], "|"), "|").otherwise("\t")
        body = S.filter(
            rows, lambda r, i: (i != head - 1) & (trim(r["line"]) != "") & ~r["line"].rlike(SEPARATOR_LINE))
        found = S.let(delimiter, lambda d: S.flatten(S.transform(
            body, lambda r: S.when(S.contains(r["line"], d), cells(r, d)).otherwise(S.array(whole(r["at"], r["line"]))))))
        return S.when((head > 0) & ruled, S.filter(found, lambda s: s["start"] < s["end"]))

    return S.let(lines, built)


def protected_verdicts(df: DataFrame, text: str, id_: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """F18 on free text from a source known to be sensitive: only a headed table is released, masked."""
    t = S.ref(text)
    rows = S.when(S.ref("_limit").isNull() & ~looks_like_json(t), _line_spans(t))
    staged = df.withColumn("_limit", S.col(limit_rule(t))).withColumn("_rows", S.col(rows))
    both = S.when(S.ref("_rows").isNotNull(), S.let(
        S.concat(detect(t, config), S.ref("_rows")),
        merge))
    staged = staged.withColumn("_merged", S.col(both))
    m = S.ref("_merged")
    rule = (
        S.when(S.ref("_limit").isNotNull(), S.ref("_limit"))
        .when(trim(t) == "", "result.clean")
        .when(m.isNull(), "result.unstructured_sensitive_source")
        .when(S.size(m) == 0, "result.clean")
        .otherwise("result.sensitive_output")
    )
    staged = staged.withColumn("rule_id", S.col(rule))
    r = S.ref("rule_id")
    return staged.select(
        id_,
        S.col(S.when(r == "result.clean", "allow").when(r == "result.sensitive_output", "sanitize")
              .otherwise("block")).alias("decision"),
        "rule_id",
        S.col(S.when(r == "result.clean", t).when(r == "result.sensitive_output", redact(t, m))).alias("content"),
    )
