"""Phrase collocations from sorted streams of counts.

Phrases are counted order by order. A phrase is counted only where both of its parts that are one word shorter reached
`least`, since no other can reach it; which parts did goes to the scan as a bitmap of bounded size, which may let a phrase
through but never holds one back, so the counts that reach `least` are exact and complete.

The counts are kept as two streams: in prefix order (by words) and in suffix order (by words from the last one). Each is
dealt by range. In prefix order a phrase follows all of its prefixes, so one lockstep walk over the stream, with a stack of
the prefixes that are open, gives each phrase the counts of its left parts and each prefix its most frequent extension; the
other stream gives right parts and extensions to the left. A range may begin inside the phrases of a prefix: the
prefixes open at its first row, three at most, are put before it. No table of phrases is held or probed anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from warden.llm import common

MOST_WORDS = 4
LEAST = 30
TOP = 2000
#: An extension with this share of a phrase's count, in hundredths, makes the phrase part of it.
PART = 80
#: Bits of the bitmap of frequent phrases: so many per phrase, up to 16 MB in all; in pieces of the bitmap functions' size.
BITS_EACH = 32
MAP_MOST = 27
PIECE_BITS = 1 << 15
#: Tokens and different words that one task holds before it hands its counts on.
CHUNK_TOKENS = 1 << 22
CHUNK_WORDS = 1 << 19
#: No byte of UTF-8; stands for the end of a piece.
_END = b"\xff"
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(chr(b).lower()) if b < 128 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with _END between pieces."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _longer(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed(hashes * _M1 + following)


class _Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _counts(ids: np.ndarray, order: int, words: list[bytes], hashes: np.ndarray, lang: int, frequent: np.ndarray | None):
    """(numbers of the words of phrases, a column per place; counts) of `order` words in a row of word numbers."""
    if order == 1:
        n = np.bincount(ids, minlength=len(words))
        found = np.flatnonzero(n[1:]) + 1
        return [found], n[found]
    # Is the phrase of order - 1 words that begins here frequent, as far as the bitmap tells?
    size = len(ids) - order + 2
    none = [np.zeros(0, np.int64)] * order, np.zeros(0, np.int64)
    if size < 2:
        return none
    rolled, whole = hashes[ids[:size]] + np.uint64(lang), ids[:size] > 0
    for k in range(1, order - 1):
        rolled = _longer(rolled, hashes[ids[k:k + size]])
        whole &= ids[k:k + size] > 0
    slot = rolled >> np.uint64(64 - int(math.log2(8 * len(frequent))))
    whole &= (frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) > 0
    at = np.flatnonzero(whole[:-1] & whole[1:])
    if not len(at):
        return none
    code, shorter = ids[at].astype(np.int64), []
    for k in range(1, order):
        if k > 1:
            found, code = np.unique(code, return_inverse=True)
            shorter.append(found)
        code = code * len(words) + ids[at + k]
    found, n = np.unique(code, return_counts=True)
    # A code is the place of the phrase without its last word, then that word.
    columns = [found % len(words)]
    place = found // len(words)
    for codes in reversed(shorter):
        columns.append(codes[place] % len(words))
        place = codes[place] // len(words)
    return [place, *reversed(columns)], n


def counted(rows: DataFrame, order: int, frequent=None) -> DataFrame:
    """(lang, phrase, n): phrases of `order` words of `rows` (lang, text as bytes); of more than one word, those whose
    parts are in the broadcast bitmap `frequent`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = frequent.value if frequent is not None else None
        numbers, held, size = _Numbers(), {}, 0

        def flush():
            words = list(numbers)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            texts = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
            for lang, parts in held.items():
                places, n = _counts(np.concatenate(parts), order, words, hashes, xxhash.xxh64_intdigest(lang), bitmap)
                for a in range(0, len(n), 1 << 16):
                    parts_of = [texts.take(pa.array(p[a:a + (1 << 16)])) for p in places]
                    some = pc.binary_join_element_wise(*parts_of, " ") if order > 1 else parts_of[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.decode()] * len(some), pa.string()), some, pa.array(n[a:a + (1 << 16)], pa.int64())],
                        ["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text)
                ids = np.zeros(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                held.setdefault(lang.encode(), []).append(ids)
                size += len(ids)
                if size > CHUNK_TOKENS or len(numbers) > CHUNK_WORDS:
                    yield from flush()
                    numbers, held, size = _Numbers(), {}, 0
        yield from flush()

    return common.map_arrow(rows, work, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"))


def _bitmap(grams: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the hashes of `n` phrases (lang, phrase)."""
    bits = min(MAP_MOST, max(PIECE_BITS.bit_length() - 1, math.ceil(math.log2(n * BITS_EACH))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = np.zeros(batch.num_rows, np.uint64)
                for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    words = [np.uint64(xxhash.xxh64_intdigest(w)) for w in phrase.encode().split(b" ")]
                    h = words[0] + np.uint64(xxhash.xxh64_intdigest(lang.encode()))
                    for w in words[1:]:
                        h = _longer(h, w)
                    out[i] = h
                yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - bits)).astype(np.int64))], ["slot"])

    slots = common.map_arrow(grams.select("lang", "phrase"), work, "slot long")
    pieces = slots.groupBy(F.expr(f"slot div {PIECE_BITS}").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("slot") % PIECE_BITS).alias("bits")).collect()  # 4 KB each, 4,096 at most
    whole = np.zeros(1 << bits - 3, np.uint8)
    for row in pieces:
        whole[row["piece"] * PIECE_BITS // 8:][:len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return whole


def frequent_phrases(rows: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of every phrase of up to `most_words` words with f >= least, (lang, n) of all words)."""
    spark = rows.sparkSession
    counts = common.saved(counted(rows, 1), "word-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    grams = counts.where(F.col("n") >= least)
    out, size = grams, grams.count()
    for order in range(2, most_words + 1):
        if not size:
            break
        shared = spark.sparkContext.broadcast(_bitmap(grams, size))
        grams = common.saved(counted(rows, order, shared).where(F.col("n") >= least), f"phrases-{order}")
        shared.destroy()
        out, size = out.unionByName(grams), grams.count()
    return out.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("f")), total


def stream(grams: DataFrame, name: str) -> DataFrame:
    """(lang, words, f, parts, longer): a lockstep walk over `grams` (lang, words, f) in the order of `words`.

    parts are the counts of a phrase's proper prefixes, the shortest first; longer is the largest count of a phrase with
    one more word (null: none). A prefix that is open over a range's edge has a row without f and parts per range.
    """
    width = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.saved(grams.repartitionByRange(width, "lang", "words").withColumn("part", F.spark_partition_id()), name)
    first = dealt.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first")).where("size(first.words) > 1")
    open_ = first.select("part", "first.lang", F.explode(F.expr(
        "transform(sequence(1, size(first.words) - 1), k -> slice(first.words, 1, k))")).alias("words"))
    spine = open_.join(dealt.select("lang", "words", "f"), ["lang", "words"]).withColumn("again", F.lit(True))
    rows = (dealt.withColumn("again", F.lit(False)).unionByName(spine).repartitionByRange(width, "part")
            .sortWithinPartitions("part", "lang", "words", F.col("again").desc()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [key, words, f, again, longer] of the prefixes that are open
        out: list[tuple] = []

        def close(depth: int):
            while len(stack) > depth:
                key, words, f, again, longer = stack.pop()
                out.append((key[1], words, None if again else f, None if again else [s[2] for s in stack], longer))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                              ["lang", "words", "f", "parts", "longer"])

        for batch in batches:
            for part, lang, words, f, again in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                key, depth = (part, lang), len(stack)
                while depth and (stack[depth - 1][0] != key or words[:depth] != stack[depth - 1][1]):
                    depth -= 1
                close(depth)
                if depth != len(words) - 1:
                    raise ValueError(f"a prefix of {words} is missing in its range")
                if stack:
                    stack[-1][4] = max(f, stack[-1][4] or 0)
                stack.append([key, words, f, again, None])
            yield batch_of(out)
            out.clear()
        close(0)
        yield batch_of(out)

    return common.map_arrow(rows.select("part", "lang", "words", "f", "again"), work,
                            "lang string, words array<string>, f long, parts array<long>, longer long")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, longer, score) of every phrase of two words or more of `grams` (lang, words, f)."""
    left = stream(grams, "prefix-stream").withColumn("rest", F.lit(None).cast("array<bigint>"))
    turned = grams.withColumn("words", F.reverse("words"))
    right = stream(turned, "suffix-stream").withColumn("words", F.reverse("words")).withColumnRenamed(
        "parts", "rest").withColumn("parts", F.lit(None).cast("array<bigint>"))
    both = left.unionByName(right).groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(
        F.max("f").alias("a"), F.max("parts").alias("parts"), F.max("rest").alias("rest"), F.max("longer").alias("longer"))
    cut = F.expr("""array_min(transform(sequence(1, size(parts)), k -> struct(
        cast(a as decimal(20, 0)) * 2000000 div (cast(parts[k - 1] as decimal(20, 0)) + rest[size(parts) - k]) as score,
        k as k, parts[k - 1] as l, rest[size(parts) - k] as r)))""")
    return both.where("size(parts) > 0").withColumn("cut", cut).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "longer", "cut.score")


def ranked(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST,
           top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Null texts count as empty and have no phrases; a null language is `und`. Repeated rows count as often as they come;
    ties go by count, then phrase in byte order. Texts of any length count whole. An empty table, or one without a phrase
    that reaches `least`, gives no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       common.text_bytes(text).alias("text"))
    grams, total = frequent_phrases(rows, most_words, least)
    found = scored(common.saved(grams, "phrases")).where(
        "longer is null or 100 * cast(longer as decimal(20, 0)) < " + str(PART) + " * cast(a as decimal(20, 0))")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A hot language is cut to its top in shares first, then over what the shares leave.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top).join(total, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
