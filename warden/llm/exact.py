"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by length, those that share a length by a hash of their first characters, and only rows that share both
are hashed in full and grouped by that. What the first two rounds leave goes to the scan of the texts as a bitmap of a
fixed size, so texts are never shuffled. A bitmap may let a row through that shares nothing, which costs one more full
hash; it never holds one back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from warden.llm import common

#: Characters of a text that the second round reads.
PREFIX = 128
#: Bits of a bitmap, in pieces of the size that the bitmap functions build: 4 MB in all, at any size of the corpus.
MAP_BITS = 1 << 25
PIECE_BITS = 1 << 15


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MAP_BITS))


def _bitmap(keys: DataFrame) -> DataFrame:
    """(piece, bits) of a frame's column slot: at most MAP_BITS / PIECE_BITS rows."""
    return keys.groupBy(F.expr(f"slot div {PIECE_BITS}").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("slot") % PIECE_BITS).alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, name: str) -> DataFrame:
    """`rows` (with slot) and a flag: is the row's bit set? The bitmap is broadcast; its size is bounded by MAP_BITS."""
    byte = F.expr(f"cast(conv(hex(substring(bits, cast((slot % {PIECE_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
    return (rows.withColumn("piece", F.expr(f"slot div {PIECE_BITS}")).join(F.broadcast(bitmap), "piece", "left")
            .withColumn(name, F.coalesce(F.getbit(byte, (F.col("slot") % 8).cast("int")) == 1, F.lit(False)))
            .drop("piece", "bits", "slot"))


def candidates(texts: DataFrame) -> DataFrame:
    """(piece, bits): bitmap of the (length, prefix hash) pairs that more than one row of `texts` (size, start) has."""
    lengths = texts.groupBy("size").count().where("count > 1").select(_slot(F.col("size")).alias("slot"))
    left = _marked(texts.withColumn("slot", _slot(F.col("size"))), _bitmap(lengths), "shared").where("shared")
    pairs = left.groupBy("size", "start").count().where("count > 1")
    return _bitmap(pairs.select(_slot(F.col("size"), F.col("start")).alias("slot")))


def _decided(docs: DataFrame, doc_id: str, text: str, prefix: int, digests: bool, whole_rows: bool) -> DataFrame:
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), own.alias("text"), *extra)
    size, start = F.octet_length("text").cast("long"), F.xxhash64(F.substring("text", 1, prefix))
    facts = common.saved(rows.select(size.alias("size"), start.alias("start")), "text-facts")
    bitmap = common.saved(candidates(facts), "shared-starts")
    read = _marked(rows.withColumn("slot", _slot(size, start)), bitmap, "surviving")
    full = F.sha2("text", 256)
    hashed = common.saved(read.select(
        "doc_id", F.monotonically_increasing_id().alias("place"), size.alias("size"),
        F.when(F.col("surviving"), full).alias("full"), *([full.alias("text_sha256")] if digests else []),
        *(["row"] if whole_rows else [])), "full-hashes")
    # Single rows never meet the join; a group is one row of it, so a hot group is split by adaptive execution.
    groups = hashed.where("full is not null").groupBy("size", "full").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "place")).alias("keep"))
    met = hashed.where("full is not null").join(groups, ["size", "full"])
    single = hashed.where("full is null").withColumns(
        {"group_size": F.lit(1).cast("long"), "keep": F.struct("doc_id", "place")})
    return met.unionByName(single)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX,
           digests: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) of every row; text_sha256 too if `digests`.

    Texts are equal when they are identical after no change. Of equal texts the row with the largest doc_id stays, and of
    several such rows one. A null text counts as empty and equals an empty one. A null doc_id is less than any other;
    a group of rows without ids has the keep_id null and one kept row. Texts of any length are read whole. An empty table
    gives no rows. Other columns are not read, whatever their names. `digests` hashes every text, not only those that share
    length and prefix with another.
    """
    out = _decided(docs, doc_id, text, prefix, digests, False)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                      (F.col("place") == F.col("keep.place")).alias("kept"), *(["text_sha256"] if digests else []))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; the rules are those of `groups`."""
    out = _decided(docs, doc_id, text, prefix, False, True)
    return out.where(F.col("place") == F.col("keep.place")).select("row.*")
