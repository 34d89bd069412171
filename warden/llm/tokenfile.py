"""Token-id files: whole texts as ids in ascending id order, coded in blocks, written by Spark and read back.

A file's rows are segments: some whole documents, their ids as one container of independently reset blocks (see
`coder`), the documents' ids and lengths beside it. Spark writes and commits the files, so a lost executor or a
repeated task leaves no half-written file behind.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from warden.llm import coder, common

#: Ids of a segment, unless one document alone has more.
SEGMENT = 1 << 22
_SCHEMA = "part int, segment int, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"
# White space of a tokenizer's normalizer; Python's own notion also holds \x1c to \x1f.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def word_tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids (little-endian 32 bits each) of texts, by a tokenizer that drops white space and never joins across it.

    Words between white space are remembered per worker. The name of a special token in a text becomes that token's id,
    as in the tokenizer's plain `encode`; such names hold no white space.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}

    def split(text):
        return _BLANKS.split(text) if any(map(text.__contains__, _ODD)) else text.split()

    def encode(texts: list[str]) -> list[bytes]:
        words = [split(t) for t in texts]
        new = list(set().union(*words).difference(known))
        if len(known) + len(new) > 600_000:
            known.clear()
            new = list(set().union(*words))
        for word, found in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[word] = np.array(found.ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, w)) for w in words]

    return encode


_TOKENIZERS: dict[str, Callable] = {}


def _tokenizer(path: str) -> Callable:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = word_tokenizer(path)
    return _TOKENIZERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
          segment: int = SEGMENT) -> None:
    """Write the ids of whole texts, each document closed by `end_id`, in ascending doc_id order to a shared folder.

    Null texts count as empty (the end id alone); null ids come first; repeated rows are written as often as they come.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        keys, sizes, parts, held, number = [], [], [], 0, 0

        def flush():
            payload = coder.encode(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())], ["part", "segment", "n_ids", "doc_ids", "sizes", "payload"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                size = len(ids) // 4 + 1
                if parts and held + size > segment:
                    yield flush()
                    keys, sizes, parts, held, number = [], [], [], 0, number + 1
                keys.append(key)
                sizes.append(size)
                parts.append(ids + end)
                held += size
        if parts:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    common.map_arrow(ordered, work, _SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    start is the number of ids before the document in all files; ids_crc32 the crc32 of its ids as little-endian
    32-bit integers; ids are those bytes. A block that does not match its checksum fails the job.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    # One row per segment and one per part: sums of a segment's millions of ids, not rows of documents.
    inside = files.select("part", "segment", "n_ids")
    parts = inside.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("of_part"),
                          (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("at"))
    within = inside.select(
        F.col("part").alias("in_part"), F.col("segment").alias("in_segment"),
        (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("on"))
    starts = within.join(before, F.col("in_part") == F.col("of_part")).select(
        "in_part", "in_segment", (F.col("at") + F.col("on")).alias("base"))
    based = files.join(starts, (F.col("part") == F.col("in_part")) & (F.col("segment") == F.col("in_segment")))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["payload"])
                sizes = np.array(row["sizes"], np.int64)
                if sizes.sum() != len(ids):
                    raise coder.Damaged("lengths of the documents do not add up")
                ends = np.cumsum(sizes)
                for at in range(0, len(sizes), common.BATCH_ROWS):
                    some = slice(at, at + common.BATCH_ROWS)
                    own = [ids[e - n:e].tobytes() for e, n in zip(ends[some].tolist(), sizes[some].tolist())]
                    columns = [pa.array(row["doc_ids"][some], pa.int64()), pa.array((ends - sizes)[some] + row["base"]),
                               pa.array(sizes[some]), pa.array([zlib.crc32(b) for b in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return common.map_arrow(based.select("base", "doc_ids", "sizes", "payload"), work, schema)
