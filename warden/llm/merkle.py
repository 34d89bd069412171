"""Merkle manifest of a table by checkpoint and recomputation, in DataFrame functions only.

Every source is a tree of the hashes of its rows, and the sources' roots are the leaves of one more tree. Only each third
level of a tree is written. A stored node stands over an aligned subtree of 4,096 stored descendants at most; both the
climb and the extraction of proofs take one such subtree in a row, make the levels between anew from its stored
descendants, use them and let them go. Proofs come down from the top: a subtree's members share what lies above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from warden.llm import common

#: Nodes of a run, and levels between two that are written.
FAN = 16
STRIDE = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 length, a colon and itself, or - if null."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """`nodes` (tree, ...) with pos, their place in their tree by `order`, and n, the tree's number of nodes.

    Trees are dealt by range, so a hot one spreads over many tasks; a task counts its rows of a tree, and the counts,
    a row per task and tree, are summed up.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.saved(nodes.repartitionByRange(width, "tree", *order).sortWithinPartitions("tree", *order)
                         .withColumn("at", F.monotonically_increasing_id()), f"{name}-order")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("own")).select(
        "part", "tree", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
        F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    return dealt.join(starts, ["part", "tree"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop(
        "at", "part", "first", "before")


def _steps(n: str) -> str:
    """Levels that a tree of n nodes climbs from one written level to the next."""
    return "case " + " ".join(f"when {n} <= {FAN ** k} then {k}" for k in range(STRIDE)) + f" else {STRIDE} end"


def _up(level: str) -> str:
    """The level above a level of one subtree."""
    return (f"transform(sequence(0, (size({level}) - 1) div {FAN}), "
            f"r -> sha2(array_join(slice({level}, cast(r * {FAN} + 1 as int), {FAN}), ''), 256))")


def _with_levels(body: str) -> str:
    """`body` over l0 (the column `stored`), l1, ... of one subtree; each level is made once."""
    for k in range(STRIDE - 1, 0, -1):
        body = f"element_at(transform(array({_up(f'l{k - 1}')}), l{k} -> {body}), 1)"
    return f"element_at(transform(array(stored), l0 -> {body}), 1)"


def _subtrees(level: DataFrame) -> DataFrame:
    """(tree, block, n, members): one row per aligned subtree, its members in order."""
    kept = [c for c in level.columns if c not in ("tree", "pos", "n")]
    return (level.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN ** STRIDE}").alias("block"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("pos", *kept))).alias("members"))
            .withColumn("stored", F.col("members.h")).withColumn("steps", F.expr(_steps("n"))))


def checkpoints(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written levels of all trees, the leaves (tree, pos, n, h, ...) first; a tree's root is where its n is 1."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots = [*[f"l{k}" for k in range(1, STRIDE)], _up(f"l{STRIDE - 1}")]
    top = "element_at(array(" + ", ".join(f"element_at({level}, 1)" for level in roots) + "), steps)"
    while most > 1:
        made = _subtrees(levels[-1]).select(
            "tree", F.col("block").alias("pos"), F.expr(f"(n - 1) div cast(power({FAN}, steps) as bigint) + 1").alias("n"),
            F.expr(_with_levels(top)).alias("h"))
        levels.append(common.saved(made, f"{name}-level"))
        most = -(-most // FAN ** STRIDE)
    return levels


def _sides(level: str, at: str) -> str:
    """What stands before and after a node in its run."""
    run = f"({at} div {FAN}) * {FAN}"
    return (f"struct(array_join(slice({level}, cast({run} + 1 as int), cast({at} - {run} as int)), '') as before, "
            f"array_join(slice({level}, cast({at} + 2 as int), cast({run} + {FAN - 1} - {at} as int)), '') as after)")


def paths(levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The leaves (tree, ... without n) with subroot and path: the sides at every level, the leaf's own first.

    `above` (tree, subroot, above) has what follows beyond each tree's root. Level by level from the top; a subtree's
    row meets its parent's path and is opened there, so no sibling is shuffled per leaf.
    """
    local = "slice(array(" + ", ".join(_sides(f"l{k}", f"(i div {FAN ** k})") for k in range(STRIDE)) + "), 1, steps)"
    members = _with_levels(f"transform(members, (m, i) -> struct(m as member, {local} as local))")
    below = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        kept = [c for c in level.columns if c not in ("tree", "pos", "n")]
        out = level.where("n = 1").join(above, "tree").select(
            "tree", "pos", *kept, "subroot", F.col("above").alias("path"))
        if below is not None:
            upper = below.select("tree", F.col("pos").alias("block"), "subroot", F.col("path").alias("upper"))
            opened = _subtrees(level).join(upper, ["tree", "block"]).select(
                "tree", "subroot", "upper", F.explode(F.expr(members)).alias("x"))
            out = out.unionByName(opened.select(
                "tree", "x.member.pos", *[f"x.member.{c}" for c in kept], "subroot",
                F.concat("x.local", "upper").alias("path")))
        below = common.saved(out.select("tree", "pos", "subroot", "path"), f"{name}-paths") if k else out
    return below


@dataclass
class Manifest:
    """The written levels of the sources' trees and of the tree over them, and the root (None for no rows)."""

    rows: list[DataFrame]
    sources: list[DataFrame]
    root: str | None


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, h): the root of each tree, from the written level where it is alone."""
    out = None
    for level in levels:
        alone = level.where("n = 1").select("tree", "h")
        out = alone if out is None else out.unionByName(alone)
    return out


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> Manifest:
    """The manifest of `docs`; its leaves also carry `changed`, the leaf of the row when tampered with, else null.

    A leaf hashes the columns named, each by its length and value, a null as -. Rows of a source stand by doc_id, rows
    without one first, then by leaf; repeated rows are leaves of their own. Rows without a source are a tree of their
    own, before all others. An empty table gives no leaves and the root None. Texts of any length count whole. Columns not
    named are not read, whatever their names. Tampered rows (5 divides the crc32 of the id) have A-Z of their text in
    lower case.
    """
    own = [F.col(f"`{c}`") for c in columns]
    other = [F.translate(F.col(f"`{c}`").cast("string"), _UPPER, _LOWER) if c == text else F.col(f"`{c}`") for c in columns]
    rows = common.saved(docs.select(
        F.struct(F.col(source).isNotNull().alias("known"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
        .alias("tree"), F.col(doc_id).alias("id"), leaf(own).alias("h"),
        F.when(common.held_out(doc_id), leaf(other)).alias("changed")), "leaf-hashes")
    leaves = common.saved(placed(rows, ["id", "h"], "leaves"), "leaves")
    levels = checkpoints(leaves, "rows")
    roots = _roots(levels).select(F.struct(F.lit(True).alias("known"), F.lit("").alias("name")).alias("tree"),
                                  F.col("tree").alias("of"), "h")
    sources = checkpoints(common.saved(placed(roots, ["of"], "sources"), "sources"), "sources")
    root = _roots(sources).first()
    return Manifest(levels, sources, root and root["h"])


def proofs(manifest: Manifest) -> DataFrame:
    """(id, h, changed, subroot, path) of every row: its leaf, its source's root and the sides at each level up to the root."""
    end = manifest.sources[0].select("tree").distinct().select(
        "tree", F.lit(manifest.root).cast("string").alias("subroot"),
        F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("above"))
    above = paths(manifest.sources, end, "sources").select(
        F.col("of").alias("tree"), F.col("h").alias("subroot"), F.col("path").alias("above"))
    return paths(manifest.rows, common.saved(above, "source-proofs"), "rows").select(
        "id", "h", "changed", "subroot", "path")


def folded(first: Column, path: Column) -> Column:
    """The root that a leaf and the sides of its path make."""
    return F.aggregate(path, first, lambda node, side: F.sha2(F.concat(side["before"], node, side["after"]), 256))


def audit(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, and what a check of the row,
    tampered with or not, makes of it. Rules of `build`."""
    manifest = build(docs, doc_id=doc_id)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proofs(manifest).select(
        F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("changed", "h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
