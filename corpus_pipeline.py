"""A corpus through five stages: quality, line dedup, near-duplicates, decontamination, token ids.

Every stage reads all that its predecessor kept and works on whole texts. A stage's result is written as Parquet and
read again before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden.llm import common, lines, machine, near, pieces, queries, templates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Labels name rows of the folder's own documents table."""
    model = machine.train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return _columns(machine.select_good(docs, model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; every document stays."""
    common.tune(spark)
    cleaned = lines.dedup_lines(_columns(docs))
    changed = F.col("n_lines_removed") > 0
    if "n_chars" in cleaned.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long"))
                                     .otherwise(F.col("n_chars")))
    return _columns(cleaned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest
    doc_id. Null ids stay."""
    common.tune(spark)
    return _columns(near.representatives(_columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _columns(templates.decontaminated(_columns(docs), common.read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left."""
    common.tune(spark)
    return pieces.encode(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("tokens", tokens)]

#: The stages hash, learn and run automata, which SQL cannot express; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, with a written table between two of them."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
