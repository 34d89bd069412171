import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, n_ids int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing column names."""
    from warden.llm import common

    common.tune(spark)
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "Same text here, twice over and over."),
            (5, "Same text here, twice over and over."), (6, "Same text here, twice over and over."), (None, "no id at all"),
            (None, None), (7, "x"), (8, "ünï çødé ▁ mark \U0001F600\x00 end"), (9, "a" * 50_000), (10, "\n" * 3000)]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, "clash", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")
