"""Helpers the corpus operators share."""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.session import ensure_checkpoint_dir, prepare

# Arrow batches stay small, so that very long texts never meet in one batch.
LLM_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def llm_session(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in LLM_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, nothing else of the caller's."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def doc_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, for Arrow tasks."""
    return doc_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def rows_by_place(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined to ``places`` (row: place in the scan); a caller's column of any name stays."""
    name = "__row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    numbers = places.select(F.col("row").alias(name))
    return docs.withColumn(name, F.monotonically_increasing_id()).join(numbers, name, how).drop(name)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def row_spans(flags: np.ndarray) -> np.ndarray:
    """(start, end) rows of the runs of True, end exclusive."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), axis=1)


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows; spans that touch become one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    first = np.flatnonzero(new)
    return np.stack((spans[first, 0], ends[np.append(first[1:] - 1, len(spans) - 1)]), axis=1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style) over uint64 arrays; wraps around."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def packed(value: object) -> bytes:
    return zlib.compress(json.dumps(value, ensure_ascii=False).encode())


def unpacked(blob: bytes) -> object:
    return json.loads(zlib.decompress(blob))


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... per key, by ``order``) and ``size`` (rows of the key), whatever the share of one key.

    Rows are dealt out by ranges of (keys, order) and sorted inside them; a
    row's number is its place in its range plus the rows of its key in earlier
    ranges, which a table of one row per range and key tells. Keys may be null.
    Rows alike in all of these are interchangeable. Columns ``__*`` are taken.
    """
    # Keys and order travel as columns: a range exchange over expressions would compute them again for its sample.
    tags = [f"__o{i}" for i in range(len(order))]
    named = df.select("*", *(c.alias(t) for c, t in zip(order, tags, strict=True)))
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *tags]]
    # The bits of a row's hash split rows that are alike in keys and order over ranges.
    spread = F.xxhash64(F.rand(7)).alias("__spread")
    dealt = named.select("*", spread).repartitionByRange(*sort, F.col("__spread")).sortWithinPartitions(*sort)
    # The checkpoint holds ranges and places fixed: a repeated task can't deal rows out anew.
    rows = pinned(dealt.select(*df.columns, F.monotonically_increasing_id().alias("__at")).withColumn(
        "__range", F.shiftrightunsigned("__at", 33)
    ))
    held = rows.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    match = ["__range", *keys]
    base = held.select(
        *(F.col(c).alias(f"__b{i}") for i, c in enumerate(match)), "__first", F.sum("__n").over(by_key).alias("size"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(match)]
    return rows.join(base, same).select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "size")
