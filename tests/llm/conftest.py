from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from packetloom.llm.common import llm_session  # noqa: E402


@pytest.fixture(scope="session")
def llm_spark(spark):
    return llm_session(spark)


@pytest.fixture(scope="session")
def tables(llm_spark, sf_dir):
    return lambda name: llm_spark.read.parquet(f"{sf_dir}/{name}.parquet")


ODD = [None, "", " \n\t\n ", "x", "the same words here\nand a second line\nand a third one", "é" * 50 + "\n" + "😀 ß " * 40]


@pytest.fixture(scope="session")
def odd_docs(llm_spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id and columns with clashing names."""
    long = "\n".join(f"line {i % 97} of a very long text with some words {i % 13}" for i in range(20_000))
    rows = [(i, t, "en", i, "c") for i, t in enumerate(ODD)] + [(4, ODD[4], None, None, None)] * 2
    rows += [(None, "text without an id but with words", "de", 1, "k"), (90, long, "en", 0, ""), (91, long, "fr", 0, "")]
    schema = "doc_id bigint, text string, lang string, row int, sha string"
    return llm_spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 AS fp", "2 AS key", "3 AS n_lines", "array('a') AS gone", "lang AS source", "4 AS score", "5 AS begins"
    ).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
