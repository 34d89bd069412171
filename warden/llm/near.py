"""Near-duplicates by word-shingle similarity, found with SimHash fingerprints in the Gray-order index.

One SimHash of a whole text tells apart what is 90 % alike, so a text gets several: one of all its shingles and one of each
of a few min-wise samples of them. Two texts of similarity s have the same sample of k shingles with about s^k, so one of
`SAMPLES` fingerprints agrees nearly always. All go through the same index (`gray.links`); texts whose fingerprints are
linked are a bucket. In a bucket a text is compared by a sketch with the texts that stand for the bucket so far, never all
with all; what looks alike is confirmed by the exact similarity of the shingle sets, and confirmed links make the classes.

What fingerprints and sketches miss comes from an exact pass (`missed`): two texts of similarity s share a shingle among the
first of each in any one order of all shingles, so texts of different classes that do are compared as well. The order puts
frequent shingles last; frequencies come from a share of the texts, which decides only how much is compared, never what is
found. Most of these pairs share a passage and no more. Parity bits of the shingle sets bound from below how much two sets differ, so
pairs that cannot have the similarity go before any set is made or shuffled (`possible`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from warden.llm import common, exact, gray

WORDS = 5
SIMILAR = 0.8
#: Samples of a text and shingles of a sample: at similarity 0.8 some sample agrees with 0.958, at 0.9 with 0.998.
SAMPLES = 6
SAMPLE = 4
#: Bytes of a sketch; texts whose sketches agree in this share are compared exactly (0.8 less three deviations).
SKETCH = 64
LOOKS_ALIKE = 0.65
#: Texts of a bucket that one task row by row compares with its centres; larger buckets are dealt in chunks.
CHUNK = 2048
#: One text in this many has its shingles counted for the order (all of a small table), which knows so many at most.
ORDER_EVERY = 8
ORDER_TEXTS = 5000
ORDER_SHINGLES = 1_000_000
_DRAW = np.random.default_rng(20).integers(0, 1 << 63, SAMPLES + SKETCH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Different hashes of a text's lower-cased word shingles, sorted; a short text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(
        starts[:1 - words].tolist(), ends[words - 1:].tolist())], np.uint64))


def facts(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(fingerprints, sketch) of the shingles of one text."""
    if not len(found):
        return np.zeros(1, np.uint64), bytes(SKETCH)
    prints = [gray.majority(found)]
    for draw in _DRAW[:SAMPLES]:
        mixed = found * draw
        kept = found[np.argpartition(mixed, SAMPLE)[:SAMPLE]] if len(found) > SAMPLE else found
        prints.append(gray.majority(kept))
    sketch = np.full(SKETCH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4096):
        sketch = np.minimum(sketch, (_DRAW[SAMPLES:, None] * found[None, at:at + 4096]).min(axis=1))
    return np.unique(np.array(prints, np.uint64)), (sketch >> np.uint64(20) & np.uint64(255)).astype(np.uint8).tobytes()


def prefix(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles of a text, in the order: any text of similarity `similar` has one of them among its own."""
    n = len(found)
    take = min(n, n - math.ceil(similar * n - 1e-9) + 1)
    common_ones, counts = order
    rank = np.zeros(n, np.int64)
    if len(common_ones):
        at = np.minimum(np.searchsorted(common_ones, found), len(common_ones) - 1)
        rank = np.where(common_ones[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[:take]]


def parity(found: np.ndarray) -> bytes:
    """Whether each slot holds an odd number of a set's shingles; two to four slots a shingle, a power of two, 64 at least."""
    slots = 1 << max(6, (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1,
                       bitorder="little").tobytes()


def _differing(one: bytes, other: bytes) -> int:
    """Slots in which two parities differ, the larger folded to the smaller: at most the shingles that one set alone has."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted by shingle, of the most frequent shingles in a share of the texts.

    The share does not shrink as the table grows, so a shingle that the order does not know is in few texts, however many
    there are, as long as the order's room lasts; beyond it the less frequent ones go.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    every = max(1, min(ORDER_EVERY, docs.count() // ORDER_TEXTS))
    some = docs.select(common.text_bytes(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    rows = common.saved(common.map_arrow(some, work, "shingle long").groupBy("shingle").agg(
        F.count("*").cast("int").alias("n")).where("n > 1"), "shingle-counts")
    room, least = ORDER_SHINGLES, 2
    for n, shingles_of in sorted((tuple(r) for r in rows.groupBy("n").count().collect()), reverse=True):
        room -= shingles_of
        if room < 0:
            least = n + 1
            break
    rows = rows.where(F.col("n") >= least).toArrow()
    known, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    by = np.argsort(known)
    return known[by], counts[by]


def _version(text: str):
    return F.unhex(F.sha2(common.text_bytes(text), 256))


def sketched(docs: DataFrame, doc_id: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, version, fps, sketch, size, parity, prefix) of every row; version is the text's digest, size its shingles."""
    order = frequent(docs, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            made = [facts(found) for found in sets]
            lists = lambda values: pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary()),
                 pa.array([len(found) for found in sets], pa.int32()), pa.array(map(parity, sets), pa.binary()),
                 lists([prefix(found, order, similar) for found in sets])],
                ["doc_id", "version", "fps", "sketch", "size", "parity", "prefix"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _version(text).alias("version"), common.text_bytes(text).alias("text")).where("doc_id is not null")
    return common.map_arrow(rows, work, "doc_id long, version binary, fps array<long>, sketch binary, size int, parity binary, "
                                  "prefix array<long>")


def _alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.flatnonzero((sketches == one).mean(axis=1) >= LOOKS_ALIKE)


_PAIRS = "bucket long, chunk int, a long, b long, sketch binary"


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, chunk, rep, sketch) in order: links to the first centre that looks alike, and the centres."""
    here, reps, held = None, [], np.zeros((0, SKETCH), np.uint8)
    for batch in batches:
        out: list[tuple] = []
        for bucket, chunk, rep, sketch in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if (bucket, chunk) != here:
                here, reps, held, n = (bucket, chunk), [], np.zeros((16, SKETCH), np.uint8), 0
            one = np.frombuffer(sketch, np.uint8)
            near = _alike(held[:n], one)
            if len(near):
                out.append((bucket, chunk, rep, reps[near[0]], None))
                continue
            if n == len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            held[n] = one
            reps.append(rep)
            n += 1
            out.append((bucket, chunk, rep, None, sketch))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         ["bucket", "chunk", "a", "b", "sketch"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the centres of two chunks of a bucket."""
    for batch in batches:
        a, b = [], []
        for reps, sketches, others, other in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            own = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)
            for rep, one in zip(others, other):
                near = _alike(own, np.frombuffer(one, np.uint8))
                a += [rep] * len(near)
                b += [reps[i] for i in near.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidates(members: DataFrame) -> DataFrame:
    """(a, b): texts of a bucket (bucket, rep, sketch) that look alike, as stars around centres.

    A large bucket is dealt in chunks; their centres go on to the next round. Once rounds no longer make a bucket much
    smaller, its chunks of centres meet pair by pair, so no bucket is ever in one task and no link between centres is lost.
    """
    level, out = members, None
    while True:
        sizes = level.groupBy("bucket").count().where("count > 1").withColumn("chunks", F.expr(f"(count - 1) div {CHUNK} + 1"))
        dealt = level.join(sizes, "bucket").select(
            "bucket", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), "rep", "sketch", "chunks")
        crowded = sizes.agg(F.sum(F.when(F.col("chunks") > 1, F.col("count")))).first()[0] or 0
        ordered = dealt.select("bucket", "chunk", "rep", "sketch").repartition("bucket", "chunk").sortWithinPartitions(
            "bucket", "chunk", "rep")
        done = common.saved(common.map_arrow(ordered, _centred, _PAIRS), "bucket-stars")
        stars = done.where("b is not null").select("a", "b")
        out = stars if out is None else out.unionByName(stars)
        if not crowded:
            return out
        large = sizes.where("chunks > 1").select("bucket")
        left = common.saved(done.where("b is null").join(large, "bucket").select(
            "bucket", "chunk", F.col("a").alias("rep"), "sketch"), "bucket-centres")
        if left.count() * 2 < crowded:
            level = left.drop("chunk")
            continue
        packed = common.saved(left.groupBy("bucket", "chunk").agg(F.collect_list(F.struct("rep", "sketch")).alias("m"))
                              .select("bucket", "chunk", "m.rep", "m.sketch"), "packed-centres")
        other = packed.select("bucket", F.col("chunk").alias("other_chunk"), F.col("rep").alias("other_rep"),
                              F.col("sketch").alias("other_sketch"))
        met = packed.join(other, "bucket").where("chunk < other_chunk").select("rep", "sketch", "other_rep", "other_sketch")
        return out.unionByName(common.map_arrow(met, _between, "a long, b long"))


def _only(docs: DataFrame, doc_id: str, ids: DataFrame, flag: str) -> DataFrame:
    """`docs` with a flag that is set for the rows with an id of `ids` (slot), and rarely for another."""
    bitmap = common.saved(exact._bitmap(ids.select(exact._slot(F.col("id")).alias("slot")).distinct()), "id-bitmap")
    return exact._marked(docs.withColumn("slot", exact._slot(F.col(doc_id).cast("long"))), bitmap, flag)


def confirmed(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, similar: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of `similar` or more; texts without words equal each other."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "own"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = _only(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", ids, "named").where("named")
    sets = common.map_arrow(some.select(F.col("doc_id").cast("long"), common.text_bytes("text").alias("text")), work,
                            "id long, own array<long>").join(ids, "id", "left_semi").dropDuplicates(["id"])
    sets = common.saved(sets, "shingle-sets")
    met = (pairs.join(sets.withColumnsRenamed({"id": "a", "own": "x"}), "a")
           .join(sets.withColumnsRenamed({"id": "b", "own": "y"}), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return met.where(shared >= F.lit(similar) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def missed(placed: DataFrame, similar: float) -> DataFrame:
    """(a, b): texts of different classes that may have the similarity; none that has it is left out.

    `placed` has a row (rep, root, size, prefix) per text. Members of one class never meet, however many they are: a shingle
    first tells which classes share it, and only their members are joined. Sizes and places in the order bound what two texts
    can have in common; a class is asked by the bounds of its members first, and meets only classes of its own level of size
    or the next, since texts of the similarity are never further apart.
    """
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / similar) + 1e-9)).cast("int")
    filed = placed.select("rep", "root", "size", level.alias("level"), F.posexplode("prefix").alias("at", "shingle"))
    shared = common.saved(filed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                          .where("low <> high").select(F.col("shingle").alias("id")), "shared-shingles")
    some = common.saved(_only(filed, "shingle", shared, "named").where("named").join(
        shared, F.col("shingle") == F.col("id"), "left_semi").select("shingle", "root", "level", "rep", "size", "at"),
        "shared-prefixes")
    spot, other_spot = ["shingle", "root", "level"], ["shingle", "other", "other_level"]
    kinds = some.groupBy(*spot).agg(F.min("size").alias("low"), F.max("size").alias("high"),
                                    F.max(F.col("size") - F.col("at")).alias("left"))
    others = kinds.withColumnsRenamed({"root": "other", "level": "other_level", "low": "low2", "high": "high2", "left": "left2"})
    share = F.lit(similar / (1 + similar))

    def may(size, high, left, size2, high2, left2):
        return ((F.least(left, left2) >= (F.col(size) + F.col(size2)) * share - 1e-6)
                & (F.col(high2) >= F.col(size) * F.lit(similar) - 1e-6) & (F.col(high) >= F.col(size2) * F.lit(similar) - 1e-6))

    up = kinds.withColumn("meets", F.explode(F.array("level", F.col("level") + 1)))
    met = up.join(others, (up["shingle"] == others["shingle"]) & (up["meets"] == others["other_level"])
                  & ((F.col("level") < F.col("other_level")) & (F.col("root") != F.col("other")) | (F.col("root") < F.col("other")))
                  & may("low", "high", F.col("left"), "low2", "high2", F.col("left2"))).select(
        up["shingle"], "root", "level", "other", "other_level")
    pairs = met.join(some, spot).join(some.withColumnsRenamed(
        {"root": "other", "level": "other_level", "rep": "rep2", "size": "size2", "at": "at2"}), other_spot)
    return pairs.where(may("size", "size", F.col("size") - F.col("at"), "size2", "size2", F.col("size2") - F.col("at2"))).select(
        F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()


def possible(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that may have the similarity by what the parities of `texts` (rep, size, parity) tell; one that has
    it always stays."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, m = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            apart = np.maximum(np.fromiter(map(_differing, x, y), np.int64, len(x)), np.abs(n - m))
            most = (n + m) * ((1 - similar) / (1 + similar)) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    facts_of = lambda side: texts.select(
        F.col("rep").alias(side), F.col("parity").alias(f"{side}_parity"), F.col("size").cast("long").alias(f"{side}_size"))
    met = pairs.join(facts_of("a"), "a").join(facts_of("b"), "b").select(
        "a", "b", "a_parity", "b_parity", "a_size", "b_size")
    return common.map_arrow(met, work, "a long, b long").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, version, component_id) of every row with an id: the smallest id of its class of near-duplicates.

    Texts are linked from a similarity of `similar` of their sets of lower-cased five-word shingles on; every class is that
    of all such links, and every link is confirmed on the texts. Equal texts are always one class. Null
    texts count as empty. Rows with a null id are left out; repeated rows give repeated rows; two texts under one id are
    rows of their own, told apart by version, the text's digest. An empty table gives no rows. Other columns are not read.
    """
    rows = common.saved(sketched(docs, doc_id, text, similar), "sketches")
    texts = common.saved(rows.groupBy("version").agg(F.min(F.struct("doc_id", "fps", "sketch", "size", "parity", "prefix")).alias("m"))
                         .select("version", F.col("m.doc_id").alias("rep"), "m.fps", "m.sketch", "m.size", "m.parity", "m.prefix"),
                         "distinct-texts")
    filed = texts.select(F.explode("fps").alias("fp"), "rep", "sketch")
    nodes = common.saved(filed.select("fp").distinct().withColumn("rep", F.col("fp")), "nodes")
    roots = gray.components(gray.links(nodes))
    members = filed.join(roots, filed["fp"] == roots["node"], "left").select(
        F.coalesce("root", "fp").alias("bucket"), "rep", "sketch").distinct()
    found = candidates(common.saved(members, "bucket-members")).where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    linked = common.saved(confirmed(docs, common.saved(found, "alike"), doc_id, text, similar), "confirmed")
    roots = gray.components(linked)
    placed = texts.join(roots, texts["rep"] == roots["node"], "left").select(
        "rep", F.coalesce("root", "rep").alias("root"), "size", "prefix")
    maybe = common.saved(missed(placed, similar), "maybe")
    maybe = common.saved(possible(maybe, texts, similar), "possible")
    more = common.saved(confirmed(docs, maybe, doc_id, text, similar), "found-late")
    roots = gray.components(linked.unionByName(more))
    top = texts.join(roots, texts["rep"] == roots["node"], "left").select(
        "version", F.coalesce("root", "rep").alias("component_id"))
    return rows.select("doc_id", "version").join(top, "version").select("doc_id", "version", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """`docs` with one document per class: that of the smallest id. Rows with a null id stay, and so do repeated rows
    of a class's smallest id. Only rows that may go are shuffled. Columns may have any names but __spare, __id, __version.
    """
    spare = common.saved(classes(docs, doc_id, text, similar).where("doc_id <> component_id").select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "spare")
    marked = _only(docs, doc_id, spare.select(F.col("__id").alias("id")), "__spare")
    doubt = marked.where("__spare").join(
        spare, (F.col(doc_id) == F.col("__id")) & (_version(text) == F.col("__version")), "left_anti")
    return marked.where("not __spare").unionByName(doubt).drop("__spare")
