"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces feeds one Viterbi pass.

The automaton reads a text once; at each end position its output links name every piece that ends there, and each of
them may improve the best score of that position. Pieces never hold a space mark after another character, so a text
falls apart at its spaces without changing the best path; such parts are remembered per worker. Characters that no
piece covers become byte pieces. Scores are those of the vocabulary file.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, functions as F

from warden.llm import common

SPACE = "▁"
#: What an uncovered character costs beyond the least likely piece.
UNKNOWN_PENALTY = 10.0
#: Parts that a worker remembers.
KNOWN_PARTS = 500_000
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """A vocabulary file of the sentencepiece library, as automaton and decoding table."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.size_of: dict[int, int] = {}
        self.byte_id: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        worst = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} goes over a space")
                self.bytes_of.append(piece.encode())
                self.automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                self.size_of[i] = len(piece)
                worst = min(worst, model.get_score(i))
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.part = common.Cache(self.best, KNOWN_PARTS)

    def best(self, part: str) -> tuple[bytes, float, bool]:
        """Ids (little-endian 32 bits each) and score of the best path, and whether the ids stand for the part's own
        bytes; ties go to the path whose last piece is longer."""
        n, unknown = len(part), self.unknown_score
        score = [0.0] + [-math.inf] * n
        back = [-1] * (n + 1)  # the piece that ends here on the best path; -1 is a character that no piece covers
        at = 0  # positions up to here are settled: a character that no piece covers costs the penalty
        for end, (i, size, value) in self.automaton.iter(part):
            while at < end:
                through = score[at] + unknown
                at += 1
                if through > score[at]:
                    score[at], back[at] = through, -1
            end += 1
            total = score[end - size] + value
            if total > score[end]:
                score[end], back[end] = total, i
        while at < n:
            through = score[at] + unknown
            at += 1
            if through > score[at]:
                score[at], back[at] = through, -1
        ids: list[int] = []
        end, sizes = n, self.size_of
        while end:
            i = back[end]
            if i >= 0:
                ids.append(i)
                end -= sizes[i]
                continue
            end -= 1
            if self.byte_id:
                ids.extend(self.byte_id[b] for b in reversed(part[end].encode("utf-8", "replace")))
            else:
                ids.append(self.unknown)
        ids.reverse()
        back_again = b"".join([self.bytes_of[i] for i in ids]) == part.encode("utf-8", "replace")
        return struct.pack(f"<{len(ids)}I", *ids), score[n], back_again

    def _parts(self, text: str) -> list[tuple[bytes, float, bool]]:
        return list(map(self.part.__getitem__, _PARTS.findall(SPACE + text.replace(" ", SPACE)))) if text else []

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a whole text; a space mark is put in front of a text that is not empty."""
        return self.encode_checked(text)[:2]

    def encode_checked(self, text: str) -> tuple[np.ndarray, float, bool]:
        """Ids and score, and whether decoding gives the text again: each part must, and the text must hold no space
        mark, which would come back as a space. Parts are decoded once, when they are first met."""
        found = self._parts(text)
        ids, scores, again = zip(*found) if found else ((), (), ())
        return np.frombuffer(b"".join(ids), "<u4"), float(sum(scores)), all(again) and SPACE not in text

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces are joined to characters, space marks become spaces, the first one goes."""
        whole = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return whole[1:] if whole.startswith(" ") else whole


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The vocabulary, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, score, ids_crc32, round_trip) of every whole text.

    ids_crc32 is the crc32 of the ids as little-endian 32-bit integers. round_trip: decoding gives the text again (not
    so for a text that holds the space mark itself). Null counts as empty, an empty text has no ids; repeated rows give
    repeated rows; other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            ids, scores, crcs, trips = [], [], [], []
            for text in batch.column(1).to_pylist():
                own, score, again = pieces.encode_checked(text)
                ids.append(own)
                scores.append(score)
                crcs.append(zlib.crc32(own.tobytes()))
                trips.append(again)
            sizes = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes),
                 pa.array(scores, pa.float64()), pa.array(crcs, pa.int64()), pa.array(trips, pa.bool_())],
                ["doc_id", "ids", "n_ids", "score", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return common.map_arrow(rows, work, "doc_id long, ids array<int>, n_ids long, score double, ids_crc32 long, "
                                        "round_trip boolean")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`rows` (doc_id, ids) as (doc_id, text); null ids give a null text, null entries and unknown ids are left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                known = None if own is None else [i for i in own if i is not None and 0 <= i < len(pieces.bytes_of)]
                texts.append(None if known is None else pieces.decode(np.array(known, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.map_arrow(rows.select(F.col("doc_id").cast("long"), F.col(ids).cast("array<int>").alias("ids")),
                            work, "doc_id long, text string")
