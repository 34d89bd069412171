"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray-code order.

A fingerprint's Gray rank is its place in the reflected Gray sequence; neighbours in that order share most bits. The
index sorts by rank, cuts the order into leaves of a few fingerprints and stacks nodes on them. A node keeps the bits
all its members share (mask) and their values (pattern); what a parent holds is not looked at again in a child. A search
adds up the differences on the way down and drops a whole node once they exceed the limit.

Distribution: 64 bits are cut into six fields. Two fingerprints that differ in at most four bits agree on at least two
whole fields, so each fingerprint is filed under the 15 pairs of fields and every link is found in one of them.
The filed rows are dealt by range of (pair value, Gray rank): a pair value that holds a large share of all rows spreads
over many partitions. A run of one value is indexed in chunks of bounded length; chunks of one value meet as nodes in a
second join that prunes on their masks first. Copies share one fingerprint and are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from warden.llm import common

#: (first bit, number of bits) of the six fields.
FIELDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = tuple(combinations(range(len(FIELDS)), 2))
#: Two of six fields agree only up to this many differing bits.
MOST_BITS = len(FIELDS) - 2
FANOUT = 16
CHUNK = 16_384
#: Searched fingerprints at a time; bounds the frontier.
QUERIES = 1024

_LANES = np.uint64(0x0101010101010101)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ---------------------------------------------------------------------------------------------------

def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the 64-bit hashes; eight byte counters are summed in one word at a time."""
    n = len(hashes)
    rows = np.zeros(-(-n // 255) * 255, np.uint64)
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts.reshape(64) * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of a text's lower-cased word shingles (XXH64, seed 42); 0 for a text without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    last = words - 1
    hashes = [digest(line[a:b], 42) for a, b in zip(starts[:-last].tolist() if last else starts.tolist(),
                                                    ends[last:].tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of each whole text; null texts count as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text"))
    return common.map_arrow(rows, work, "doc_id long, fp long")


# --- the index ------------------------------------------------------------------------------------------------------

def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the reflected Gray sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def _filed(fp: Column) -> Column:
    """The 15 pair values of a fingerprint, each with its pair's number in front."""
    field = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in FIELDS]
    return F.array(*[F.lit(k << 22).cast("long").bitwiseOR(F.shiftleft(field[a], 11)).bitwiseOR(field[b])
                     for k, (a, b) in enumerate(PAIRS)])


class Index:
    """Nodes over fingerprints that are sorted by (group, Gray rank); each group has a root of its own."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        n = len(fps)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        # Items of one level: places where they begin, and the group they are in.
        begin, owner = np.arange(n), np.searchsorted(starts, np.arange(n), "right") - 1
        every, some = fps, fps
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            first = np.searchsorted(owner, np.arange(len(starts)))
            slot = np.arange(len(begin)) - first[owner]
            head = np.flatnonzero(slot % FANOUT == 0)
            every = np.bitwise_and.reduceat(every, head) if len(head) else every
            some = np.bitwise_or.reduceat(some, head) if len(head) else some
            stop = np.r_[head[1:], len(begin)] if len(head) else head
            mask = ~(every ^ some)
            self.levels.append((head, stop, mask, every & mask))
            begin, owner = begin[head], owner[head]
            if len(begin) == len(starts):
                break
        self.root_of = np.searchsorted(starts, np.arange(n), "right") - 1

    def near(self, queries: np.ndarray, roots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) places with at most `limit` differing bits, below the root given for each query."""
        q, node = np.arange(len(queries)), roots
        spent, seen = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for level in range(len(self.levels) - 1, -1, -1):
            head, stop, mask, pattern = self.levels[level]
            # Only bits that the parent did not settle are compared; the sum decides about the whole node.
            fresh = mask[node] & ~seen
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & fresh)
            keep = spent <= limit
            q, node, spent = q[keep], node[keep], spent[keep]
            seen = mask[node]
            size = stop[node] - head[node]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            node_next = np.repeat(head[node], size) + offset
            q, spent, seen, node = np.repeat(q, size), np.repeat(spent, size), np.repeat(seen, size), node_next
        spent = spent + np.bitwise_count((queries[q] ^ self.fps[node]) & ~seen)
        keep = spent <= limit
        return q[keep], node[keep]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the classes of linked places; a label is the smallest place of its class."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _linked(fps: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Class label of each place after all links inside the groups."""
    index, labels = Index(fps, group), np.arange(len(fps))
    _, size = np.unique(index.root_of, return_counts=True)
    busy = np.flatnonzero(np.repeat(size, size) > 1)
    for at in range(0, len(busy), QUERIES):
        part = busy[at:at + QUERIES]
        q, entry = index.near(fps[part], index.root_of[part], limit)
        labels = merge(labels, part[q], entry)
    return labels


def _from_rank(rank: np.ndarray) -> np.ndarray:
    rank = rank.view(np.uint64)
    return rank ^ (rank >> np.uint64(1))


_FOUND = "key long, a long, b long, low long, mask long, pattern long, ranks array<long>, reps array<long>"


def _chunks(limit: int, chunk: int):
    """Index sorted rows run by run; give star links of each chunk, and the chunks whose run may go on elsewhere."""
    def links(reps, labels):
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        if len(moved):
            yield pd.DataFrame({"key": None, "a": reps[moved], "b": reps[labels[moved]], "low": None, "mask": None,
                                "pattern": None, "ranks": None, "reps": None})

    def open_rows(keys, ranks, fps, reps, cut):
        """One row per run in `cut`, with the bits its fingerprints share."""
        rows = []
        for a, b in cut:
            every, some = np.bitwise_and.reduce(fps[a:b]), np.bitwise_or.reduce(fps[a:b])
            mask = ~(every ^ some)
            rows.append({"key": keys[a], "a": None, "b": None, "low": ranks[a], "mask": int(mask.view(np.int64)),
                         "pattern": int((every & mask).view(np.int64)), "ranks": ranks[a:b], "reps": reps[a:b]})
        if rows:
            yield pd.DataFrame(rows)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, going_on = [], True  # the first run may have begun in the partition before

        def flush(rows, last=False, alone=False):
            nonlocal going_on
            keys, ranks, reps = (np.concatenate([r[i] for r in rows]) for i in range(3))
            fps = _from_rank(ranks)
            yield from links(reps, _linked(fps, keys, limit))
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[edge[1:], len(keys)]
            # A run that fills the chunk alone may go on in the next one, wherever it began.
            cut = [(edge[0], ends[0])] if going_on or alone else []
            if last and (len(edge) > 1 or not going_on):
                cut.append((edge[-1], ends[-1]))
            yield from open_rows(keys, ranks, fps, reps, cut)

        size = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append((frame["key"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64),
                         frame["rep"].to_numpy(np.int64)))
            size += len(frame)
            if size < chunk:
                continue
            keys, ranks, reps = (np.concatenate([r[i] for r in held]) for i in range(3))
            # Stop before the last run unless it fills the chunk alone.
            stop = int(np.searchsorted(keys, keys[-1]))
            alone = stop == 0
            stop = len(keys) if alone else stop
            yield from flush([(keys[:stop], ranks[:stop], reps[:stop])], alone=alone)
            going_on = alone
            held, size = ([(keys[stop:], ranks[stop:], reps[stop:])], len(keys) - stop) if stop < len(keys) else ([], 0)
        if held:
            yield from flush(held, last=True)

    return work


def _across(limit: int):
    """Links between two chunks of one pair value: the members of one are searched in the index of the other."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x, y, rx, ry in zip(frame["ranks"], frame["other_ranks"], frame["reps"], frame["other_reps"]):
                left, right = _from_rank(np.asarray(x, np.int64)), _from_rank(np.asarray(y, np.int64))
                reps = np.concatenate([np.asarray(rx, np.int64), np.asarray(ry, np.int64)])
                index, labels = Index(right, np.zeros(len(right), np.int8)), np.arange(len(reps))
                for at in range(0, len(left), QUERIES):
                    part = left[at:at + QUERIES]
                    q, entry = index.near(part, np.zeros(len(part), np.int64), limit)
                    labels = merge(labels, q + at, entry + len(left))
                moved = np.flatnonzero(labels != np.arange(len(labels)))
                if len(moved):
                    yield pd.DataFrame({"a": reps[moved], "b": reps[labels[moved]]})

    return work


def links(nodes: DataFrame, limit: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between representatives whose fingerprints differ in at most `limit` bits.

    `nodes` has one row (fp, rep) per distinct fingerprint. Inside a chunk, links come as stars on one member, so a
    group of near copies gives a row per member, and every class stays connected as by all its pairs.
    """
    if not 0 <= limit <= MOST_BITS:
        raise ValueError(f"this filing finds links up to {MOST_BITS} bits")
    filed = nodes.select(F.explode(_filed(F.col("fp"))).alias("key"), gray_rank(F.col("fp")).alias("rank"), "rep")
    ordered = filed.repartitionByRange("key", "rank").sortWithinPartitions("key", "rank")
    found = common.saved(ordered.mapInPandas(_chunks(limit, chunk), _FOUND), "gray-chunks")
    inside = found.where("a is not null").select("a", "b")
    chunks = found.where("key is not null")
    other = chunks.select(F.col("key").alias("other_key"), F.col("low").alias("other_low"),
                          F.col("mask").alias("other_mask"), F.col("pattern").alias("other_pattern"),
                          F.col("ranks").alias("other_ranks"), F.col("reps").alias("other_reps"))
    differ = F.bit_count(F.col("pattern").bitwiseXOR(F.col("other_pattern"))
                         .bitwiseAND(F.col("mask")).bitwiseAND(F.col("other_mask")))
    pairs = chunks.join(other, (F.col("key") == F.col("other_key")) & (F.col("low") < F.col("other_low"))
                        & (differ <= limit))
    return inside.unionByName(
        pairs.select("ranks", "reps", "other_ranks", "other_reps").mapInPandas(_across(limit), "a long, b long"))


# --- classes --------------------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    Large-star and small-star rounds until the links stand still; each round is a table in the shared folder.
    """
    def state(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.saved(edges, "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own: the join then has two plain exchanges, and a hub's rows can be split at run time.
        low = common.saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
                           "least-near")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.saved(large.where("a <> b").distinct(), "large-star")
        low = common.saved(large.groupBy("a").agg(F.min("b").alias("m")), "least-below")
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = common.saved(small.where("a <> b").distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4,
                    limit: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over links of at most `limit` differing bits, the row's own id
    included. Texts without words (null, empty, white space) have fingerprint zero and link like any other. Repeated
    rows give repeated rows. A null id takes part in no class of its own: its row gets the class of its fingerprint,
    null if no row with an id has that fingerprint. An empty table gives an empty table. Other columns are not read.
    """
    fps = common.saved(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    nodes = common.saved(nodes, "nodes")
    roots = components(links(nodes, limit))
    classes = (nodes.join(roots, nodes["rep"] == roots["node"], "left")
               .select(F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("component_id")))
    return (fps.join(classes, fps["fp"] == classes["class_fp"], "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one document per class: that of the smallest id. Rows with a null id stay, and so do repeated rows
    of a class's smallest id."""
    spare = (near_duplicates(docs, doc_id, text, **options).where("doc_id <> component_id")
             .select(F.col("doc_id").alias("__spare")).distinct())
    return docs.join(spare, F.col(doc_id) == F.col("__spare"), "left_anti")
