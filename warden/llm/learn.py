"""Small helpers of the two classifiers: a bounded labelled sample and standard scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from warden.llm import common

#: Labelled rows that a classifier is fitted on, at most. They are those of the smallest id hash, so the choice
#: neither follows the order of the table nor changes from run to run.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold; null ids and labels are left out."""
    chosen = (labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label"))
              .where("label_id is not null and label is not null").where(~common.held_out("label_id"))
              .groupBy("label_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    # At most `rows` pairs of numbers, so a broadcast has a known bound.
    return (docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("label_id"))
            .select(F.col("label_id").alias("doc_id"), common.text_bytes(text).alias("text"), "label"))


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each column; a column without spread is left as it is."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(spread > 1e-9, spread, 1.0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
