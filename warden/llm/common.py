"""What the text operators share: tables, session settings, durable intermediate tables, per-worker word caches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from warden import session

#: Rows of one Arrow batch; texts may be long, so a batch is small.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Session settings of the text jobs: those of the library and small Arrow batches."""
    session.tune(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder, by Spark's own reader, so that the folder may be in any store."""
    return tune(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return os.path.join(session.checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, lost executors cost nothing twice."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: str) -> Column:
    """UTF-8 of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def id_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo `modulus`; the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: str = "doc_id", modulus: int = 5, fold: int = 0) -> Column:
    """Is the row kept out of learning? A null id is not held out."""
    return F.coalesce(id_crc(F.col(doc_id), modulus) == fold, F.lit(False))


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow without a barrier; `work` sees batches of plain Arrow columns."""
    return df.mapInArrow(work, schema)


class Cache(dict):
    """Remembers a function of a word in one Python worker; starts anew when it holds `limit` words."""

    def __init__(self, function: Callable, limit: int = 200_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.function(word)
        return value
