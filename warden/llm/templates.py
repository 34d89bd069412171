"""Benchmark decontamination by templates: exact and re-parameterised questions in a corpus.

Words become template tokens: numbers, units and names are placeholders, other words their lower-cased selves. Windows
of template tokens are hashed in documents and items alike; equal windows meet in a hash join. What filled the
placeholders is then compared along each alignment: within one match, one filler of the item must always stand for the
same filler in the document, else the windows agree by form only.

A bitmap of fixed size tells in the scan which windows can meet at all; a full one would cost time, not results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from warden.llm import common

WINDOW = 8
#: Share of an item's words that must be matched, and words that must not be placeholders.
COVERAGE = 0.5
LITERALS = 4
MAP_BITS = 24
PIECES = 64

# Unit names and number words that count as placeholders.
UNITS = frozenset("""mm cm m km mg g kg t ml l s sec min h hr hrs hour hours minute minutes second seconds day days week
weeks month months year years meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms
liter liters litre litres dollar dollars euro euros cent cents percent usd eur gb mb kb hz khz mhz ghz w kw v""".split())
NUMBERS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
million""".split())
_NUMBER = re.compile(r"[$€£#]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STOP = re.compile(r"[.!?:;][\"')\]]*$")
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_NEWLINE = "\x00"


def _digest(value: str) -> int:
    return xxhash.xxh64_intdigest(value, 7)


_SLOT = {NUMBER: _digest("\x01number"), UNIT: _digest("\x01unit"), NAME: _digest("\x01name")}


def word_facts(word: str) -> tuple[int, int, int, int]:
    """(hash at a sentence start, hash elsewhere, kind elsewhere, ends a sentence); hash 0: not a word."""
    if word == _NEWLINE:
        return 0, 0, LITERAL, 1
    stop = int(bool(_STOP.search(word)))
    bare = _EDGES.sub("", word)
    if not bare:
        return 0, 0, LITERAL, stop
    low = bare.lower()
    if _NUMBER.fullmatch(bare) or low in NUMBERS:
        return _SLOT[NUMBER], _SLOT[NUMBER], NUMBER, stop
    if low in UNITS:
        return _SLOT[UNIT], _SLOT[UNIT], UNIT, stop
    literal = _digest(low)
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return literal, _SLOT[NAME], NAME, stop
    return literal, literal, LITERAL, stop


class _Facts(dict):
    """Word facts by number, for numpy look-ups; starts anew when it holds many words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.table = limit, np.zeros((1024, 4), np.uint64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[number] = word_facts(word)
        return number

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[numbers]


def tokens(text: str, facts: _Facts, first_is_name: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(hash, kind) of each template token of a whole text, its words and the place of each token in them.

    A capitalised word at the start of a sentence is an ordinary word, or a name like any other with `first_is_name`.
    """
    words = text.replace("\n", f" {_NEWLINE} ").split()
    return _read(words, facts(words), first_is_name) if words else _read([], np.zeros((0, 4), np.uint64), False)


def _read(words: list[str], table: np.ndarray, first_is_name: bool):
    start = np.r_[True, table[:-1, 3] == 1][:len(words)] & (not first_is_name)
    hashes = np.where(start, table[:, 0], table[:, 1])
    kinds = np.where(start & (table[:, 2] == NAME), LITERAL, table[:, 2]).astype(np.int64)
    real = np.flatnonzero(hashes)
    return hashes[real], kinds[real], words, real


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        out = out * factor + hashes[k:k + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)


def _fillers(kinds: np.ndarray, words: list[str], real: np.ndarray, at: int, size: int) -> list[str]:
    """What fills the placeholders of one window, with their places in it."""
    return [f"{k}\x01{_EDGES.sub('', words[real[at + k]]).lower()}" for k in np.flatnonzero(kinds[at:at + size])]


_WINDOWS = "row_id long, gram long, at int, size int, n_tokens int, fillers array<string>"
_COLUMNS = [part.split()[0] for part in _WINDOWS.split(", ")]


def _windows(bitmap: np.ndarray | None, sizes: list[int] | None):
    """Windows of each text, of items (no bitmap) all, in both readings of capitalised words at sentence starts."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts = _Facts()
        for frame in frames:
            out: list[tuple] = []
            for row_id, text in zip(frame["row_id"].tolist(), frame["text"].tolist()):
                seen = set()
                words = text.replace("\n", f" {_NEWLINE} ").split()
                table, before = facts(words) if words else np.zeros((0, 4), np.uint64), None
                for first_is_name in (False, True):
                    hashes, kinds, words, real = _read(words, table, first_is_name)
                    n = len(hashes)
                    # Only windows with a sentence start that the two readings take differently are new.
                    other = None if before is None else np.r_[0, np.cumsum(hashes != before)]
                    before = hashes
                    if other is not None and not other[-1]:
                        break
                    for size in (sizes if sizes is not None else [min(WINDOW, n)]):
                        grams = window_hashes(hashes, size) if size else np.zeros(0, np.uint64)
                        at = np.arange(len(grams))
                        if other is not None and len(grams):
                            at = np.flatnonzero(other[size:size + len(grams)] > other[:len(grams)])
                        if bitmap is not None:
                            slot = grams[at] >> np.uint64(64 - MAP_BITS)
                            at = at[np.flatnonzero(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)]
                        signed = grams.view(np.int64)
                        for k in at.tolist():
                            if (key := (int(signed[k]), k)) not in seen:
                                seen.add(key)
                                out.append((row_id, key[0], k, size, n, _fillers(kinds, words, real, k, size)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return work


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all item windows: 2 MB at any size, put together by pieces on the executors."""
    shift = 64 - MAP_BITS
    piece_bits = MAP_BITS - PIECES.bit_length() + 1

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: dict[int, np.ndarray] = {}
        for frame in frames:
            slots = frame["gram"].to_numpy(np.int64).view(np.uint64) >> np.uint64(shift)
            for piece in np.unique(slots >> np.uint64(piece_bits)).tolist():
                own = slots[slots >> np.uint64(piece_bits) == piece] & np.uint64((1 << piece_bits) - 1)
                part = bits.setdefault(piece, np.zeros(1 << piece_bits - 3, np.uint8))
                np.bitwise_or.at(part, own >> np.uint64(3), np.uint8(1) << (own & np.uint64(7)).astype(np.uint8))
        if bits:
            yield pd.DataFrame({"piece": list(bits), "bits": [b.tobytes() for b in bits.values()]})

    piece = F.shiftrightunsigned("gram", shift + piece_bits)
    rows = (items.select("gram").distinct().repartition(PIECES, piece)
            .mapInPandas(pieces, "piece long, bits binary").collect())
    whole = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for row in rows:
        at = row["piece"] << piece_bits - 3
        whole[at:at + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
    return whole


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, exact): the items found in each document, one row per pair.

    coverage is the share of the item's tokens in matched windows of the best alignment; `exact` says that all fillers
    are the item's own. A pair is given if coverage reaches `coverage`, the fillers are consistent and matched
    windows hold LITERALS ordinary words, or are the whole item with its own fillers: a question of few words counts as
    found only where it is copied. Texts without words and null texts hold nothing; an item
    shorter than a window is one window. Null ids are kept out. Repeated rows give one pair.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("row_id"), F.coalesce(F.col(item_text), F.lit(""))
                             .alias("text")).where("row_id is not null").distinct()
    items = common.saved(items.mapInPandas(_windows(None, None), _WINDOWS), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().where("size > 0").collect())  # at most WINDOW
    rows = docs.select(F.col(doc_id).cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.where("row_id is not null").mapInPandas(_windows(_bitmap(items), sizes), _WINDOWS)
    item = items.select("gram", F.col("row_id").alias("item_id"), F.col("at").alias("item_at"), "n_tokens",
                        F.col("fillers").alias("item_fillers"), "size")
    met = (found.select("gram", F.col("row_id").alias("doc_id"), "at", "fillers").join(item, "gram")
           .where(F.size("fillers") == F.size("item_fillers")))
    pairs = F.zip_with("item_fillers", "fillers", lambda x, y: F.concat_ws("\x02", x, y))
    aligned = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.countDistinct("item_at").alias("n_windows"), F.first("n_tokens").alias("n_tokens"),
        F.array_distinct(F.flatten(F.collect_set(F.transform(
            F.sequence(F.lit(0), F.col("size") - 1), lambda k: k + F.col("item_at"))))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_set(F.transform(pairs, lambda p: F.concat_ws(
            "\x02", F.substring_index(F.substring_index(p, "\x02", 1), "\x01", -1),
            F.substring_index(F.substring_index(p, "\x02", -1), "\x01", -1)))))).alias("bound"),
        F.max(F.size("fillers")).alias("slots"), F.max("size").alias("size"))
    left = F.transform("bound", lambda b: F.substring_index(b, "\x02", 1))
    same = F.forall("bound", lambda b: F.substring_index(b, "\x02", 1) == F.substring_index(b, "\x02", -1))
    share = F.size("covered") / F.col("n_tokens")
    good = aligned.where(
        (share >= coverage) & (F.size(F.array_distinct(left)) == F.size("bound"))
        & ((F.size("covered") - F.size("bound") >= LITERALS) | (same & (F.size("covered") == F.col("n_tokens")))))
    return good.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max(share).alias("coverage"), F.max(same).alias("exact"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; rows with a null id stay."""
    held = contamination(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, F.col(doc_id) == F.col("__held"), "left_anti")
