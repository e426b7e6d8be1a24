"""Line deduplication by winnowing over line hashes.

A run counts when it has ``min_lines`` lines or ``min_words`` words. For each
line the shortest such run that begins with it, and the shortest that ends
with it, is a window; the least line hash of a window is its fingerprint, so
any two equal runs share one. Fingerprints that occur once in the corpus end
there. The windows around a repeated fingerprint reach out both ways from it
and meet their earliest equal; windows with an earlier equal overlap into
maximal matches, whose lines go. The first copy stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import pinned

MIN_LINES, MIN_WORDS = 3, 50


def line_windows(text: bytes, min_lines: int, min_words: int) -> tuple[list[int], dict[tuple[int, int], int]]:
    """(hash of each line with words, {(first, end) line: fingerprint}) of a text; lines without words don't count."""
    lines = [line for line in (x.strip() for x in text.split(b"\n")) if line]
    hashes = [xxhash.xxh3_64_intdigest(x) - 2**63 for x in lines]
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines]))).astype(np.int64)
    at = np.arange(n)
    # Shortest window from each line on, and up to each line.
    ends = np.minimum(at + min_lines, np.searchsorted(total, total[:-1] + min_words))
    begins = np.maximum(at + 1 - min_lines, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    windows = {(a, e) for a, e in zip(at.tolist(), ends.tolist(), strict=True) if e <= n}
    windows |= {(b, a + 1) for a, b in zip(at.tolist(), begins.tolist(), strict=True) if b >= 0}
    return hashes, {(a, e): min(hashes[a:e]) for a, e in windows}


def _run_hash(hashes: list[int]) -> bytes:
    return xxhash.xxh3_128_digest(np.array(hashes, np.int64).tobytes())


def drop_lines(text: bytes, gone: set[int]) -> bytes:
    """The text without the lines of these numbers (lines without words aren't numbered and stay)."""
    kept, number = [], -1
    for line in text.split(b"\n"):
        if line.strip():
            number += 1
            if number in gone:
                continue
        kept.append(line)
    return b"\n".join(kept)


def repeated_runs(rows: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(row, first, end): windows of lines that have an earlier equal, for rows (row, text binary)."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "print", "first", "end", "run"]
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes, windows = line_windows(text, min_lines, min_words)
                for (a, e), least in windows.items():
                    for column, value in zip(columns, (row, least, a, e, _run_hash(hashes[a:e])), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    windows = rows.mapInArrow(winnow, "row bigint, print bigint, first int, end int, run binary")
    # One row per fingerprint and task before the shuffle; a window pair makes two.
    prints = windows.groupBy("print").agg(
        F.min(F.struct("row", "first", "end")).alias("least"), F.max(F.struct("row", "first", "end")).alias("most")
    ).filter("least != most").select("print")
    seeds = pinned(windows.join(prints, "print"))
    earliest = seeds.groupBy("run").agg(
        F.min(F.struct("row", "first")).alias("place"), F.max(F.struct("row", "first")).alias("final")
    ).filter("place != final").drop("final")
    later = (F.col("place.row") < F.col("row")) | (F.col("place.first") < F.col("first"))
    return seeds.join(earliest, "run").filter(later).select("row", "first", "end")


RESULT = ("doc_id", "text", "n_lines", "n_removed", "kept_sha256")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without repeated runs of lines: doc_id, text, n_lines, n_removed, kept_sha256, extra columns of ``docs``.

    A line goes if it lies in a run of consecutive lines, of ``min_lines``
    lines or ``min_words`` words at least, that also starts at an earlier place
    (row order, then line). Lines are compared without white space at their
    ends; lines without words are no part of runs and stay. Null texts count
    as empty and come back empty; rows repeated under one doc_id are documents
    of their own, the later loses its runs; an empty table gives no rows.
    Columns of the input that clash with a result column give way to it.
    ``docs`` is scanned more than once and must give its rows in the same order
    each time, as a table read does.
    """
    cleaned, names = _cleaned(docs, min_lines, min_words)
    return cleaned.select(*RESULT, *(F.col(n).alias(c) for c, n in names.items() if c not in RESULT))


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the text cleaned as by ``dedup_lines`` and n_chars, if there, following it."""
    cleaned, names = _cleaned(docs, min_lines, min_words)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return cleaned.select(*((new[c].cast(kinds[c]) if c in new else F.col(n)).alias(c) for c, n in names.items()))


def _cleaned(docs: DataFrame, min_lines: int, min_words: int) -> tuple[DataFrame, dict[str, str]]:
    """(result columns and the input's under safe names, {input column: safe name})."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    numbered = F.monotonically_increasing_id().alias("row")
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), numbered)
    lines = repeated_runs(rows, min_lines, min_words).select(
        "row", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("line")
    )
    # A document's own lines only.
    gone = lines.groupBy("row").agg(F.collect_set("line").alias("gone"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                kept = drop_lines(text, set(lines)) if lines else text
                n = sum(1 for x in text.split(b"\n") if x.strip())
                values = kept.decode("utf-8", "replace"), n, len(lines or ()), hashlib.sha256(kept).hexdigest()
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            found = (pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))
            carried = [batch.column(n) for n in names.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found, *carried], [*RESULT, *names.values()])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "doc_id bigint, text string, n_lines bigint, n_removed bigint, kept_sha256 string, "
    schema += ", ".join(f"{n} {kinds[c]}" for c, n in names.items())
    # The text itself travels once; its own column is made from it again.
    carried = [(F.lit(None).cast(kinds[c]) if c == "text" else F.col(f"`{c}`")).alias(n) for c, n in names.items()]
    marked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        numbered, *carried,
    )
    return marked.join(gone, "row", "left").mapInArrow(remove, schema), names
