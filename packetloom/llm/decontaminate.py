"""Benchmark decontamination by the q-gram lemma in diagonal bands.

A passage of m characters with at most k edits keeps m - q + 1 - k q of its
q-grams, all on diagonals within k of each other. Shared q-grams are counted
per item in overlapping diagonal bands of width 2 (k + 1); a band that meets
the bound is a region, and a banded alignment verifies it. The benchmark is a
query set that every document meets, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, mix64, rows_by_place

Q = 8
EDIT_RATE = 0.08
# Benchmark characters in one block; the index of a block is broadcast.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lower(raw: bytes) -> str:
    """ASCII letters in lower case, so that every character keeps its place."""
    return raw.lower().decode("utf-8", "replace").replace("\0", " ")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q characters, by joining runs of powers of two."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = codes.astype(np.uint64), 1, 0, None
    while True:
        if q & size:
            part = power[done : done + n]
            out = part if out is None else (out * np.uint64(0x9E3779B97F4A7C15)) ^ part
            done += size
        if 2 * size > q:
            return mix64(out)
        joined = power[: len(power) - size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:]
        power, size = joined ^ (joined >> np.uint64(29)), 2 * size


@dataclass
class ItemIndex:
    """q-grams of a block of items: sorted hashes with the (item, place) pairs behind each."""

    ids: list[int]
    texts: list[str]
    q: int
    rate: float

    def __post_init__(self) -> None:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        # The largest budget that still leaves one shared gram.
        most = np.maximum(0, (sizes - self.q) // self.q)
        self.budget = np.minimum(np.floor(sizes * self.rate).astype(np.int64), most)
        self.least = sizes - self.q + 1 - self.budget * self.q
        self.short = [i for i, n in enumerate(sizes) if n < self.q]
        grams = [gram_hashes(_codes(t), self.q) for t in self.texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int64)
        self.item, self.place = item[order], place[order]
        self.quick = np.zeros(1 << FILTER_BITS, bool)
        self.quick[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> np.ndarray:
        """(item, first diagonal of a band) rows that meet the q-gram bound."""
        grams = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.quick[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.empty((0, 2), np.int64)
        found = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        true = self.hashes[found] == grams[at]
        at, found = at[true], found[true]
        many = self.first[found + 1] - self.first[found]
        total = int(many.sum())
        if not total:
            return np.empty((0, 2), np.int64)
        entry = np.repeat(self.first[found] - np.cumsum(many) + many, many) + np.arange(total)
        item, diagonal = self.item[entry], np.repeat(at, many) - self.place[entry]
        step = self.budget[item] + 1
        band = diagonal // step
        # Each hit lies in two overlapping bands.
        key = np.concatenate((band, band - 1)) + (1 << 40) + (np.concatenate((item, item)) << 42)
        key, count = np.unique(key, return_counts=True)
        item = key >> 42
        band = (key & ((1 << 42) - 1)) - (1 << 40)
        kept = count >= self.least[item]
        return np.stack((item[kept], band[kept] * (self.budget[item[kept]] + 1)), axis=1)

    def matches(self, text: str, codes: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(begin, end, edits) of the item's best place in the region, or None beyond the budget."""
        k, wanted = int(self.budget[item]), self.texts[item]
        low = max(0, diagonal - k)
        high = min(len(text), diagonal + 2 * (k + 1) + len(wanted) + k)
        at = text.find(wanted, low, high)
        if at >= 0:
            return at, at + len(wanted), 0
        pattern = _codes(wanted)
        region = codes[low:high]
        end, edits = banded_end(pattern, region, 4 * (k + 1) + 1, k)
        if edits > k:
            return None
        back, _ = banded_end(pattern[::-1], region[:end][::-1], 4 * (k + 1) + 1, k)
        return low + end - back, low + end, edits


def banded_end(pattern: np.ndarray, region: np.ndarray, width: int, k: int) -> tuple[int, int]:
    """(end in the region, edits) of the best alignment of all of ``pattern`` that begins in the first ``width`` places.

    Only cells within ``k`` diagonals of such a begin are filled.
    """
    n = len(region)
    far = len(pattern) + n + 1
    # Column c of row i stands for region place i + c - k.
    span = width + 2 * k + 1
    offsets = np.arange(span)
    row = np.where((offsets - k >= 0) & (offsets - k <= min(n, width)), 0, far)
    padded = np.full(len(pattern) + span + n, np.uint32(0xFFFFFFFF))
    padded[k : k + n] = region
    for i, letter in enumerate(pattern):
        place = i + 1 + offsets - k
        diagonal = row + (padded[i + offsets] != letter)
        above = np.append(row[1:], far) + 1
        best = np.minimum(diagonal, above)
        best[(place < 0) | (place > n)] = far
        if i + 1 <= k:
            zero = k - i - 1
            best[zero] = min(best[zero], i + 1)
        row = np.minimum.accumulate(best - offsets) + offsets
        row[(place < 0) | (place > n)] = far
    c = int(np.argmin(row))
    return min(n, max(0, len(pattern) + c - k)), int(row[c])


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks whose size is proven before they are fetched."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).filter(F.col("item_id").isNotNull() & (F.length(F.trim(F.col("text").cast("string"))) > 0))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    found = (items.filter(block == i).distinct().orderBy("item_id", "text").collect() for i in range(n))
    return [[(r.item_id, _lower(bytes(r.text))) for r in rows] for rows in found]


MATCH = "array<struct<item_id:bigint,begin:bigint,end:bigint,edits:int>>"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Benchmark passages in ``docs`` (doc_id, text): doc_id, row, matches.

    ``benchmark`` has item_id and text. A match is an item found whole with at
    most ``rate`` times its length in edits (fewer for items so short that no
    q-gram would be left; items under q characters match exactly); ASCII case
    is ignored, begin and end are code points. Null or blank items and null
    texts match nothing; rows repeated under one doc_id each give a row; empty
    tables give no rows or no matches; other columns are ignored. ``row`` is
    the place of the row in the scan.
    """
    sc = docs.sparkSession.sparkContext
    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    parts = []
    for items in benchmark_blocks(benchmark, block_chars):
        # At most block_chars of text, as counted above.
        handed = sc.broadcast(items)
        parts.append(rows.mapInArrow(_search(handed, q, rate), f"doc_id bigint, row bigint, matches {MATCH}"))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("matches")).alias("matches")
    ).select("doc_id", "row", F.array_sort("matches").alias("matches"))


def _search(handed, q: int, rate: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex([i for i, _ in handed.value], [t for _, t in handed.value], q, rate)
        for batch in batches:
            texts = [_lower(t) for t in batch.column("text").to_pylist()]
            # Documents end to end; no gram of an item holds the separator.
            body = "\0".join(texts)
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            ends = np.cumsum(sizes)
            found: list[set] = [set() for _ in texts]
            codes = _codes(body)
            for item, diagonal in index.regions(codes).tolist():
                # A region near a border may concern either neighbour.
                middle = min(max(0, diagonal + index.budget[item] + 1 + len(index.texts[item]) // 2), len(body))
                d = min(int(np.searchsorted(ends, middle, "right")), len(texts) - 1)
                begin = int(ends[d] - sizes[d])
                hit = index.matches(texts[d], codes[begin : begin + len(texts[d])], item, diagonal - begin)
                if hit:
                    found[d].add((index.ids[item], *hit))
            for item in index.short:
                for d, text in enumerate(texts):
                    at = text.find(index.texts[item])
                    if at >= 0:
                        found[d].add((index.ids[item], at, at + len(index.texts[item]), 0))
            lists = [[dict(zip(("item_id", "begin", "end", "edits"), m, strict=True)) for m in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(lists, kind)], ["doc_id", "row", "matches"]
            )

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any match, all columns kept, whatever their names.

    Null and empty texts hold no item and stay, long texts are searched whole;
    rows repeated under one doc_id are judged each by its own text. An empty
    ``docs`` gives no rows, an empty ``benchmark`` drops none.
    """
    return rows_by_place(docs, find_contamination(docs, benchmark, **options).filter(F.size("matches") == 0), "left_semi")
