"""Corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each result as Parquet in the shared checkpoint folder
and reads it back for the next stage. In all stages a null text counts as
empty, long texts are read whole, repeated rows are rows of their own, an
empty table gives no rows, and columns of any name stay until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from packetloom.llm.common import llm_session, table
from packetloom.session import ensure_checkpoint_dir

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores under one half; the model learns from the labels of these documents."""
    spark = llm_session(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines that an earlier one has; n_chars follows the text."""
    llm_session(spark)
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id.

    Linked are fingerprints within four bits, found by the vantage-point forest,
    and five-word shingle sets with a Jaccard similarity of 0.8 or more.
    """
    llm_session(spark)
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    spark = llm_session(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, without their token ids."""
    llm_session(spark)
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# Tokenizer, suffix-order and grammar stages are beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(llm_session(spark), sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
