"""Exact deduplication: a static binary-fuse filter of a snapshot screens new digests.

Texts are equal when their bytes match after white space (space, tab, line
feed, vertical tab, form feed, carriage return) is deleted. The digests of an
immutable snapshot go, shard by shard, into binary-fuse filters (about nine
bits a digest). The distinct digests of a new batch probe them: a negative is
certainly new and never meets the snapshot again, a positive joins the exact
digest bucket. Duplicates inside the new batch are grouped on their own first.
Rows of groups with several members are then compared byte by byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, mix64, pinned

WHITE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 100_000
# Filters of repeated digests up to this size travel to the second scan as a
# broadcast; beyond it the texts of that scan are dealt out by shard instead.
BROADCAST_FILTER_BYTES = 64 << 20


class BinaryFuse8:
    """3-wise binary-fuse filter with 8-bit fingerprints over distinct uint64 keys."""

    def __init__(self, seed: int, segment: int, spread: int, table: np.ndarray):
        self.seed, self.segment, self.spread, self.table = seed, segment, spread, table

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        low = np.uint64(segment - 1)
        h0 = ((h >> np.uint64(32)) * np.uint64(spread)) >> np.uint64(32)
        h1 = (h0 + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        h2 = (h0 + np.uint64(2 * segment)) ^ (h & low)
        return np.stack((h0, h1, h2)).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys)
        n = len(keys)
        segment = 4 if n < 2 else 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
        factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        for seed in range(1, 200):
            # A few failed seeds on a tiny set call for more room.
            spread = max(1, math.ceil(n * factor * (1 + 0.02 * (seed - 1)) / segment) - 2) * segment
            table = cls._peel(keys, seed, segment, spread)
            if table is not None:
                return cls(seed, segment, spread, table)
        raise ValueError("no seed gave a filter")

    @classmethod
    def _peel(cls, keys: np.ndarray, seed: int, segment: int, spread: int) -> np.ndarray | None:
        at, prints = cls.places(keys, seed, segment, spread)
        size = spread + 2 * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, pick = np.unique(owner[alone], return_index=True)
            rounds.append((key, alone[pick]))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(count, touched, 1)
            for row in at:
                np.bitwise_xor.at(owner, row[key], key)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return None
        table = np.zeros(size, np.uint8)
        # Keys of one round share no slot that another of them owns.
        for key, slot in reversed(rounds):
            a, b, c = at[:, key]
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
        return table

    def probe(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self.places(keys, self.seed, self.segment, self.spread)
        return prints == (self.table[a] ^ self.table[b] ^ self.table[c])


def _normal(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells repeated rows apart), sha (32 bytes), key (its first 8), n_points."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            shas = [hashlib.sha256(_normal(t)).digest() for t in texts]
            # Continuation bytes start no code point.
            points = [len(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(shas, pa.binary()),
                 pa.array(np.frombuffer(b"".join(s[:8] for s in shas), ">i8").astype("i8")), pa.array(points, pa.int64())],
                ["doc_id", "row", "sha", "key", "n_points"],
            )

    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(digests, "doc_id bigint, row bigint, sha binary, key bigint, n_points bigint")


def group_best(rows: DataFrame) -> DataFrame:
    """One row per digest: members and the row that stays (longest text, smallest id, first row)."""
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return rows.groupBy("sha", "key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of the distinct keys: shard, seed, segment, spread, table."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        fuse = BinaryFuse8.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({
            "shard": [pdf["shard"].iloc[0]], "seed": [fuse.seed], "segment": [fuse.segment], "spread": [fuse.spread],
            "table": [fuse.table.tobytes()],
        })

    return (
        keys.select("key", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(build, "shard int, seed int, segment int, spread int, table binary")
    )


def _filter_of(row) -> BinaryFuse8:
    return BinaryFuse8(int(row.seed), int(row.segment), int(row.spread), np.frombuffer(row.table, np.uint8))


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The incoming groups (sha, key) with ``maybe``: false only if the snapshot lacks the digest."""

    def probe(new: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
        if len(new) and len(fuse):
            new["maybe"] = _filter_of(next(fuse.itertuples())).probe(new["key"].to_numpy().view(np.uint64))
        else:
            new["maybe"] = False
        return new[["sha", "maybe"]]

    keyed = incoming.select("sha", "key", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "sha binary, maybe boolean")


def dedup_batches(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Groups over a snapshot and a new batch: sha, key, n, best.

    Both are ``text_digests`` rows. Only incoming digests that the filter
    cannot rule out join the snapshot's digests.
    """
    old, new = pinned(group_best(snapshot)), pinned(group_best(incoming))
    shards = max(1, math.ceil(max(old.count(), new.count()) / SHARD_KEYS))
    screened = screen(new, build_filters(old, shards), shards)
    new = pinned(new.join(screened, "sha"))
    hits = new.filter("maybe").select("sha", F.col("n").alias("n_new"), F.col("best").alias("best_new"))
    # The old side keeps every group; what the positives add is merged in.
    merged = old.join(hits, "sha", "left").select(
        "sha", "key", (F.col("n") + F.coalesce("n_new", F.lit(0))).alias("n"), F.least("best", "best_new").alias("best")
    )
    fresh = new.filter("maybe").join(old.select("sha"), "sha", "left_anti").unionByName(new.filter("not maybe"))
    return merged.unionByName(fresh.select("sha", "key", "n", "best"))


def check_bytes(docs: DataFrame, groups: DataFrame) -> None:
    """Compare the members of each larger group byte by byte.

    A second scan passes only texts whose digest may belong to a larger group
    (again a binary-fuse filter). Raises if two texts share a digest.
    """
    spark = docs.sparkSession
    several = groups.filter("n > 1").select("sha", "key")
    total = several.count()
    if not total:
        return
    shards = max(1, math.ceil(total / SHARD_KEYS))
    filters = build_filters(several, shards)
    handed = None
    if total * 1.3 <= BROADCAST_FILTER_BYTES:
        handed = spark.sparkContext.broadcast({r.shard: tuple(r)[1:] for r in filters.collect()})

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuses = {
            k: BinaryFuse8(v[0], v[1], v[2], np.frombuffer(v[3], np.uint8)) for k, v in (handed.value if handed else {}).items()
        }
        for batch in batches:
            out: dict[str, list] = {"sha": [], "body": []}
            bodies = [_normal(t) for t in batch.column("text").to_pylist()]
            shas = [hashlib.sha256(b).digest() for b in bodies]
            keys = np.frombuffer(b"".join(s[:8] for s in shas), ">i8").astype("i8")
            keep = np.ones(len(keys), bool) if handed is None else np.zeros(len(keys), bool)
            for shard, fuse in fuses.items():
                mine = np.flatnonzero(keys % shards == shard)
                keep[mine] = fuse.probe(keys[mine].view(np.uint64))
            for i in np.flatnonzero(keep):
                out["sha"].append(shas[i])
                out["body"].append(bodies[i])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("sha", pa.binary()), ("body", pa.binary())]))

    texts = doc_bytes(docs).mapInArrow(repeated, "sha binary, body binary")
    # Equal bytes have one least and one greatest member. Each task passes on one
    # row per digest at most, so a group with a third of all rows stays small.
    differs = texts.groupBy("sha").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low != high")
    if differs.limit(1).count():
        raise ValueError("two different texts share one SHA-256")


def exact_dedup(docs: DataFrame, split: int | None = None) -> DataFrame:
    """Duplicate groups of ``docs`` (doc_id, text): one row per input row.

    Rows with doc_id below ``split`` (default: the middle of the id range) form
    the snapshot, the others the new batch. Returns doc_id, keep_id,
    group_size, kept, text_sha256. A null text counts as empty and empty texts
    equal each other. Of equal texts the one with most code points stays, then
    the smallest doc_id (null ids last); of rows repeated under one id exactly
    one is marked kept. An empty table gives no rows; other columns of the
    input are ignored.
    """
    rows = pinned(text_digests(docs))
    if split is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        split = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") < F.lit(split), F.lit(False))
    groups = pinned(dedup_batches(rows.filter(old), rows.filter(~old)))
    check_bytes(docs, groups)
    found = groups.select(
        "sha", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")
    )
    return rows.join(found, "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
