"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from warden.llm import (bootstrap, collocations, common, exact, grammar, gray, lines, machine, merkle, ngrams, pieces, statements,
                        templates, tiff, tokenfile)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Statements of queries that SQL can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_machine")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return machine.score(docs, machine.train(docs, common.read(spark, folder, "labels")))


@query("op2_sentence_pieces")
def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(common.read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op3_template_contamination")
def _contamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contamination(common.read(spark, folder, "documents"), common.read(spark, folder, "benchmark"))


@query("op4_gray_simhash")
def _near(spark: SparkSession, folder: str) -> DataFrame:
    return gray.near_duplicates(common.read(spark, folder, "documents"))


@query("op5_token_files")
def _token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    path = common.shared_path(spark, "token-files")
    tokenfile.write(docs, path, vocabulary("word_bpe_49k.json"))
    return tokenfile.read(spark, path, with_ids=False)


@query("op7_bloom_ngrams")
def _language(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.score(common.read(spark, folder, "documents"))


@query("op8_tiff_pages")
def _tiff(spark: SparkSession, folder: str) -> DataFrame:
    return tiff.digests(common.read(spark, folder, "documents"))


@query("op6_line_winnowing")
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines_left"),
                                          "n_lines_removed", "text")


@query("op9_clause_grammar")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return grammar.score(docs, grammar.train(docs, common.read(spark, folder, "labels")))


@query("op10_bootstrapped_contexts")
def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return bootstrap.personal_data(common.read(spark, folder, "documents"))


@query("op11_count_streams", statements.COLLOCATIONS)
def _collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.ranked(common.read(spark, folder, "documents"))


@query("op12_merkle_manifest", statements.MERKLE)
def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(common.read(spark, folder, "documents"))


@query("op13_exact_refinement", statements.EXACT)
def _exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups(common.read(spark, folder, "documents"), digests=True)
