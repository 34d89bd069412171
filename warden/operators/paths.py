"""Path rules as an index of their literal parts: for rule tables of any size.

A pattern can only match a path that holds each of its literal components, its extension or its literal runs. Patterns
are compiled on the executors, each once; of the parts of a pattern the one that fewest paths hold is its key, so a
common folder name is no key where a rarer part is at hand. Paths meet patterns in an equi-join on that key, and the
regex is asked on those pairs alone, in an order in which each pattern is compiled once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from warden.functions import sql as S
from warden.functions.globs import compile_path
from warden.functions.paths import bad_component, covers, normalize  # noqa: F401  (public names)

#: Length of a literal run that is a key for patterns without a literal component or extension.
RUN = 3
_INDEX = "pattern string, regex string, parts array<string>, heads array<string>"


def parts_of(pattern: str) -> list[str]:
    """What every match of a pattern must hold: name:COMPONENT, ext:EXTENSION, else run:LETTERS, all in lower case."""
    bare = pattern[3:] if pattern.startswith("**/") else pattern
    pieces = bare.split("/")
    found = ["name:" + p.lower() for p in pieces if p and not re.search(r"[*?\[\]{}]", p)]
    extension = re.fullmatch(r"[^\[\]{}]*\.([^.*?\[\]{}]+)", pieces[-1])
    if extension:
        found.append("ext:" + extension.group(1).lower())
    if not found and not re.search(r"[\[\]{}]", bare):
        found = ["run:" + run[:RUN].lower() for run in re.split(r"[*?/]+", bare) if len(run) >= RUN]
    return sorted(set(found))


def _compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pattern in batch.column(0).to_pylist():
            glob = compile_path(pattern)
            heads = ["/".join(glob.prefix[:n]).lower() for n in range(1, len(glob.prefix))]
            rows.append((pattern, glob.regex, parts_of(pattern), heads))
        strings = pa.list_(pa.string())
        kinds = (pa.string(), pa.string(), strings, strings)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)],
            ["pattern", "regex", "parts", "heads"])


def compiled(patterns: DataFrame) -> DataFrame:
    """(pattern, regex, parts, heads) of the distinct patterns of a frame; heads are the folders above a pattern's literal
    beginning. A pattern that a policy may not hold ends the job; rule_quality finds such patterns."""
    return patterns.select("pattern").distinct().mapInArrow(_compiled, _INDEX)


def _holds(path: str, runs: bool) -> Column:
    """The keys a path can answer to."""
    low = S.lower(S.ref(path))
    names = S.transform(S.filter(S.split(low, "/"), lambda c: c != ""), lambda c: S.concat(S.lit("name:"), c))
    keys = [names, S.array(S.concat(S.lit("ext:"), S.substring_index(low, ".", -1)))]
    if runs:
        keys.append(S.transform(S.sequence(1, S.greatest(S.length(low) - (RUN - 1), S.lit(1))),
                                lambda i: S.concat(S.lit("run:"), low.substr(i, RUN))))
    return S.col(S.array_distinct(S.concat(*keys)))


def match_patterns(paths: DataFrame, patterns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, pattern, by...) of every distinct path and pattern that match; both frames carry the ``by`` columns."""
    own = paths.select("path", *by).distinct()
    wanted = patterns.select("pattern", *by).distinct()
    index = wanted.join(compiled(wanted), "pattern").select("pattern", *by, "regex", "parts")
    runs = bool(index.where(F.exists("parts", lambda p: p.startswith("run:"))).limit(1).count())
    held = own.withColumn("key", F.explode(_holds("path", runs)))
    # How many paths hold a part, of the parts that any pattern has.
    keys = index.select("*", F.explode("parts").alias("key"))
    often = held.join(keys.select("key", *by).distinct(), ["key", *by], "left_semi").groupBy("key", *by).count()
    # A pattern with a part that no path holds matches nothing and leaves here.
    rarest = keys.join(often, ["key", *by], "left").groupBy("pattern", "regex", *by).agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key")).alias("least")).where("least.count > 0")
    met = held.join(rarest.select("pattern", "regex", *by, F.col("least.key").alias("key")), ["key", *by])
    # What has no literal part has to be asked of every path: paths are dealt by a salt, such patterns go to each share.
    salts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loose = index.where("size(parts) = 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")).join(loose, ["salt", *by])
    pairs = met.select("path", "pattern", "regex", *by).unionByName(asked.select("path", "pattern", "regex", *by))
    # regexp_instr keeps the last pattern it compiled; rlike would compile the regex of every row.
    return pairs.sortWithinPartitions("regex").where("regexp_instr(path, regex) > 0").drop("regex")


def match_rules(paths: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every match of a row of ``paths`` (path, the ``by`` columns and any others) with a rule row (pattern, ...)."""
    hits = match_patterns(paths, rules, by)
    return paths.join(hits, ["path", *by]).join(rules, ["pattern", *by])


def first_rules(paths: DataFrame, rules: DataFrame, by: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """The rows of ``paths`` with a match, with ``first_rule`` (least ``order``) and ``n_rules``.

    Rules that share a pattern are one row of the join, and so are rows that share a path.
    """
    folded = rules.groupBy("pattern", *by).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    hits = match_patterns(paths, rules, by).join(folded, ["pattern", *by]).groupBy("path", *by).agg(
        F.min("first").alias("first_rule"), F.sum("copies").alias("n_rules"))
    return paths.join(hits, ["path", *by])


def tree_matches(paths: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, pattern, by...) where the path is a folder above what a pattern protects, or protected itself.

    Above means that the folder ends in a beginning of the pattern's literal part, so both meet on that part's last name.
    """
    own = paths.select("path", *by).distinct()
    wanted = rules.select("pattern", *by).distinct()
    index = wanted.join(compiled(wanted), "pattern")
    heads = index.select("pattern", *by, F.explode("heads").alias("head")).withColumn(
        "last", F.substring_index("head", "/", -1))
    above = own.withColumn("last", F.lower(F.substring_index("path", "/", -1))).join(heads, ["last", *by]).where(
        F.concat(F.lit("/"), F.lower("path")).endswith(F.concat(F.lit("/"), F.col("head"))))
    # A pattern without a literal beginning protects something below every folder.
    floating = wanted.where(F.regexp_replace("pattern", r"^\*\*/", "").rlike(r"^[^/]*[*?\[{]"))
    salts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    everywhere = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")).join(
        floating.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["salt", *by])
    both = above.select("path", "pattern", *by).unionByName(everywhere.select("path", "pattern", *by))
    return both.unionByName(match_patterns(paths, rules, by).select("path", "pattern", *by)).distinct()
