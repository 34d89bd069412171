"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each pair of inputs interacts through the inner product of two short vectors. The sum over all pairs is taken in time
linear in the inputs: half of (square of the sum minus sum of the squares), per vector dimension.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from warden.llm import common, learn

BUCKETS = 512
RANK = 6
#: Mini-batches of a fit, however many rows there are, and rows of a batch.
STEPS, BATCH = 600, 256
#: Words of a text after which its distinct words are looked at anew, so that long texts compare with short ones.
STRETCH = 200

# Names of the statistics, in their order in a feature row.
STATISTICS = ("letters", "upper", "digits", "blanks", "marks", "pipes", "beyond_ascii", "control", "word_length",
              "distinct", "neighbours", "commonest", "odd_ends", "repeated_lines", "line_length", "packed", "entropy",
              "empty")
METADATA = ("log_bytes", "log_words", "log_lines")
WIDTH = BUCKETS + len(STATISTICS) + len(METADATA)

_CLASS = np.zeros((256, 8))
for _i, _in in enumerate((
        lambda c: chr(c).isalpha() and c < 128, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in b" \t",
        lambda c: 33 <= c < 127 and not chr(c).isalnum(), lambda c: c == 124, lambda c: c > 127,
        lambda c: c < 32 and c not in b"\t\n\r")):
    _CLASS[:, _i] = [_in(c) for c in range(256)]


def _bucket(word: bytes) -> int:
    """Bucket of a word, and whether it ends in something other than a letter, digit or plain stop."""
    odd = not (word[-1:].isalnum() or word[-1] > 127 or word[-1:] in b".,;:?!\"')")
    return zlib.crc32(word) % BUCKETS * 2 + odd


def features(text: bytes, bucket) -> np.ndarray:
    """Feature row of one whole text: a unit vector of hashed words, then statistics and metadata."""
    row = np.zeros(WIDTH, np.float32)
    words = text.split()
    n, size = len(words), len(text)
    found = np.fromiter(map(bucket.__getitem__, words), np.int64, n)
    counts = np.log1p(np.bincount(found >> 1, minlength=BUCKETS))
    row[:BUCKETS] = counts / max(np.sqrt((counts * counts).sum()), 1e-9)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = histogram @ _CLASS / max(size, 1)
    lines = text.split(b"\n")
    used = histogram[histogram > 0] / max(size, 1)
    distinct = same = 0
    for at in range(0, n, STRETCH):
        distinct += len(set(words[at:at + STRETCH]))
    if n > 1:
        same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    row[BUCKETS:] = [
        *share, (size - histogram[32] - histogram[10]) / max(n, 1) / 10, distinct / max(n, 1), same / max(n, 1),
        max(Counter(words).values(), default=0) / max(n, 1), (found & 1).sum() / max(n, 1),
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), len(zlib.compress(text, 1)) / (size + 20),
        -(used * np.log2(used)).sum(), not n, np.log1p(size), np.log1p(n), np.log1p(len(lines))][:WIDTH - BUCKETS]
    return row


assert len(STATISTICS) + len(METADATA) == 8 + 10 + 3  # eight shares of characters, ten further statistics, metadata


@dataclass
class Machine:
    """Weights of a fitted machine; `score` is the probability of label 1."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.spread, -6, 6) / 3
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return learn.sigmoid(self.margin(self.scaled(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.vectors
        pairs = 0.5 * ((summed ** 2).sum(axis=1) - (x ** 2) @ (self.vectors ** 2).sum(axis=1))
        return self.bias + x @ self.weights + pairs


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, steps: int = STEPS, seed: int = 1) -> Machine:
    """Fit by mini-batches of log loss with Adam; rows in a fixed random order."""
    random = np.random.default_rng(seed)
    mean, spread = learn.scaling(x[:, BUCKETS:].astype(np.float64)) if len(x) else (np.zeros(1), np.ones(1))
    machine = Machine(0.0, np.zeros(WIDTH), random.normal(0, 0.02, (WIDTH, rank)), mean, spread)
    if not len(x) or y.min() == y.max():
        machine.bias = 0.0 if not len(x) else (6.0 if y[0] else -6.0)
        machine.vectors[:] = 0
        return machine
    x = machine.scaled(x)
    machine.bias = float(np.log(y.mean() / (1 - y.mean())))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in
             (("weights", machine.weights), ("vectors", machine.vectors), ("bias", np.zeros(1)))}
    size, order = min(BATCH, len(x)), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < size:
            order = random.permutation(len(x))
        part, order = order[:size], order[size:]
        xs = x[part]
        error = (learn.sigmoid(machine.margin(xs)) - y[part]) / size
        squares = (xs ** 2).T @ error
        gradient = {"weights": xs.T @ error + 1e-5 * machine.weights, "bias": np.array([error.sum()]),
                    "vectors": (xs * error[:, None]).T @ (xs @ machine.vectors) - squares[:, None] * machine.vectors
                    + 1e-4 * machine.vectors}
        for name, g in gradient.items():
            m, v = state[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            if name == "bias":
                machine.bias -= float(move[0])
            else:
                setattr(machine, name, getattr(machine, name) - move)
    return machine


def select_good(docs: DataFrame, machine: Machine, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with all their columns but `__bytes`."""
    at = len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = common.Cache(_bucket)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t, bucket) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(machine.score(x) >= threshold)).select(list(range(at)))

    return common.map_arrow(docs.withColumn("__bytes", common.text_bytes(text)), work, docs.schema)


def _mapped(rows: DataFrame, schema: str, finish) -> DataFrame:
    """Feature rows of (doc_id, text, ...) given to `finish` batch by batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = common.Cache(_bucket)
        for batch in batches:
            if batch.num_rows:
                yield finish(batch, np.stack([features(t, bucket) for t in batch.column(1).to_pylist()]))

    return common.map_arrow(rows, work, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = learn.SAMPLE_ROWS,
          doc_id: str = "doc_id", text: str = "text") -> Machine:
    """A machine fitted on at most `rows` labelled documents; features are made on the executors."""
    sample = learn.labelled_sample(docs, labels, label, rows, doc_id, text)
    width = 4 * WIDTH
    made = _mapped(sample, "doc_id long, label int, row binary", lambda batch, x: pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())],
        ["doc_id", "label", "row"])).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(made.column("row").to_pylist()), np.float32).reshape(-1, width // 4)
    return fit(x, made.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null texts count as empty and are scored like any other; repeated rows give repeated rows; an empty table gives an
    empty table; other columns are not read. With no labelled rows to learn from, all scores are one half.
    """
    def finish(batch, x):
        value = machine.score(x)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(value),
                                           pa.array((value >= threshold).astype(np.int32))],
                                          ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text"))
    return (_mapped(rows, "doc_id long, score double, predicted int", finish)
            .select("doc_id", common.held_out().alias("held_out"), "score", "predicted"))
