"""Personal data by bootstrapped contexts: what is known by its form teaches where it stands, and that finds more.

Seeds are the addresses and numbers that patterns of characters find. The words around them are lexical patterns. Spark
scores the graph of patterns and instances in rounds: a pattern is trusted for a kind if enough different known
instances stand in it and hardly anything else does; an instance is trusted if trusted patterns hold it; trusted
instances count as known in the next round, until a round finds no new one. All places of trusted instances are given beside the seeds' own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from warden.llm import common

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many different known instances and this share of all its places; an instance this score.
INSTANCES = 3
PRECISION = 0.8
TRUST = 0.8
#: Unknown words with a digit and at least so many characters can be instances.
LEAST = 5
MAP_BITS = 22

# The character patterns of the kinds. Look-behinds and possessive repeats only keep them linear.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from each @ on: the local part reaches back over its characters, not into the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        # Without a match the text up to this @ is spent as well: no later local part can hold it.
        done = max(done, at + 1)
        at = text.find("@", done)


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the character patterns find: leftmost, not overlapping within a kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                      if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- contexts -------------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGE = np.uint64(0x5851F42D4C957F2D)


def word_hash(word: str) -> int:
    """Hash of a context word: lower-cased, without marks around it, digits alike."""
    return xxhash.xxh64_intdigest(_DIGIT.sub("#", _EDGES.sub("", word).lower()))


def _patterns(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(3, n) pattern hashes from the two words before and the two after: both before, one on each side, both after."""
    out = []
    for k, (x, y) in enumerate(((a, b), (b, c), (c, d))):
        mixed = (x * _M1 ^ (y + np.uint64(k + 1))) * _M2
        out.append(mixed ^ (mixed >> np.uint64(31)))
    return np.stack(out)


def _around(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word the two before and the two after."""
    edged = np.concatenate([[_EDGE, _EDGE], hashes, [_EDGE, _EDGE]]).astype(np.uint64)
    n = len(hashes)
    return edged[:n], edged[1:n + 1], edged[3:n + 3], edged[4:n + 4]


def mentions(text: str, found: list[tuple[int, int, int]], hash_of) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, instance hash, patterns) of the seeds and of other words with digits."""
    if not found and not _DIGIT.search(text):
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = np.array([w[0] for w in words]), np.array([w[1] for w in words])
    hashes = np.array([hash_of[text[a:b]] for a, b in words], np.uint64)
    edged = np.concatenate([[_EDGE, _EDGE], hashes, [_EDGE, _EDGE]]).astype(np.uint64)
    rows, taken = [], np.zeros(len(words), bool)
    for a, kind, b in found:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left")) - 1
        taken[first:last + 1] = True
        rows.append((a, b, kind, first, last))
    for i in np.flatnonzero(~taken).tolist():
        word = text[words[i][0]:words[i][1]]
        if len(word) >= LEAST and _DIGIT.search(word):
            bare = _EDGES.sub("", word)
            if len(bare) >= LEAST:
                a = words[i][0] + word.index(bare)
                rows.append((a, a + len(bare), -1, i, i))
    out = []
    for a, b, kind, first, last in rows:
        own = _patterns(edged[first:first + 1], edged[first + 1:first + 2], edged[last + 3:last + 4],
                        edged[last + 4:last + 5])[:, 0]
        out.append((a, b, kind, xxhash.xxh64_intdigest(text[a:b].lower()) - (1 << 63), own.view(np.int64).tolist()))
    return out


_MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()),
                               ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scan(rows: DataFrame) -> DataFrame:
    """One row per text: its seeds spelled out, their counts, its mentions."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = common.Cache(word_hash)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [seeds(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in f) for f in found] for kind in range(len(KINDS))]
            names = ["start", "end", "kind", "instance", "patterns"]
            made = [[dict(zip(names, m)) for m in mentions(t, f, hash_of)] for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([spelled(f) for f in found], pa.string()), pa.array(made, _MENTION)],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base", "mentions"])

    return common.map_arrow(rows, work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
                            "mentions array<struct<start:int,end:int,kind:int,instance:bigint,patterns:array<bigint>>>")


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """Which places of a table of fixed size (512 KB) some wanted pattern falls on."""
    at = F.shiftrightunsigned("pattern", 64 - MAP_BITS)
    words = (patterns.select(F.shiftright(at, 5).cast("int").alias("word"),
                             F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31).cast("long"))
                                               .cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())  # at most 2**17 rows
    out = np.zeros(1 << MAP_BITS - 5, np.uint32)
    for row in words:
        out[row["word"]] = row["bits"]
    return out


def _places(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): in how many places of all texts each wanted pattern stands around a word."""
    bits = _bitmap(patterns)
    if not bits.any():
        return patterns.select("pattern", F.lit(0).cast("long").alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = common.Cache(word_hash)
        for batch in batches:
            seen = []
            for text in batch.column(1).to_pylist():
                words = text.split()
                hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
                own = _patterns(*_around(hashes)).reshape(-1)
                at = own >> np.uint64(64 - MAP_BITS)
                seen.append(own[(bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)) > 0])
            found, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())],
                                             ["pattern", "n"])

    counted = common.map_arrow(rows, work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("places"))
    return patterns.join(counted, "pattern", "left").select("pattern", F.coalesce("places", F.lit(0)).alias("places"))


def trusted(graph: DataFrame, places: DataFrame) -> DataFrame:
    """(instance, kind) of the instances that become trusted.

    `graph` has (instance, pattern, kind, n): how often an instance stands in a pattern; kind is -1 for unknown ones.
    What is trusted stays so with its kind, hence the set grows until it stands still.
    """
    known = common.saved(graph.select("instance", "kind").where("false"), "trusted")
    unknown = graph.where("kind < 0").select("instance", "pattern", "n")
    seeded = graph.where("kind >= 0")
    while True:
        taken = seeded.unionByName(unknown.join(known, "instance"))
        scored = (taken.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("instances"),
                                                       F.sum("n").alias("held"))
                  .where(F.col("instances") >= INSTANCES).join(places, "pattern")
                  .select("pattern", "kind", (F.col("held") / F.greatest("held", "places")).alias("precision"))
                  .where(F.col("precision") >= PRECISION))
        # A chance per pattern that it is wrong; all of them must be wrong for the instance to be.
        held = (unknown.join(scored, "pattern").groupBy("instance", "kind")
                .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-3)))))).alias("score"))
                .where(F.col("score") >= TRUST))
        found = held.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("best")).select(
            "instance", (-F.col("best.rank")).cast("int").alias("kind"))
        new = common.saved(found.join(known, "instance", "left_anti"), "trusted-new")
        if new.isEmpty():
            return known
        known = common.saved(known.unionByName(new), "trusted")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    Counts and base_sha256 are of the seeds; spans holds them and what the contexts found, by start and kind, as
    kind:start:end in code points. Found spans are words that no seed touches. Null texts count as empty; repeated rows
    give repeated rows (and count as often in contexts); an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scanned = common.saved(_scan(rows).withColumn("row", F.monotonically_increasing_id()), "mentions")
    spread = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    graph = (spread.select("instance", "kind", F.explode("patterns").alias("pattern"))
             .groupBy("instance", "kind", "pattern").agg(F.count("*").alias("n")))
    graph = common.saved(graph, "contexts")
    # Only patterns that may come to hold enough instances can be trusted.
    wanted = (graph.groupBy("pattern").agg(F.countDistinct("instance").alias("k"))
              .where(F.col("k") >= INSTANCES).select("pattern"))
    graph = common.saved(graph.join(wanted, "pattern"), "graph")
    places = common.saved(_places(rows, graph.select("pattern").distinct()), "places")
    found = trusted(graph, places).select(F.col("instance").alias("is"), F.col("kind").alias("as"))
    more = (spread.where("kind < 0").join(found, F.col("instance") == F.col("is"))
            .groupBy("row").agg(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end")).alias("more"))
            .withColumnRenamed("row", "of"))
    names = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0),
                       lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    text_of = F.array_join(F.transform(every, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.join(more, F.col("row") == F.col("of"), "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        text_of.alias("spans"))
