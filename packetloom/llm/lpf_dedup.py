"""Repeated substrings by longest-previous-factor arrays over suffix order.

A repeat of at least ``width`` bytes starts at a window of that many bytes that
occurs twice. Equal windows have the same smallest gram hash, so each run of
windows with one smallest gram (a fragment) goes to that gram's shard; grams
that occur once in the corpus are dropped before any text moves, and fragments
of equal content travel once. Inside a shard the suffixes are ordered by rank
doubling up to the width. In suffix order the neighbours with a smaller and a
larger position tell whether the longest previous (or next) factor at a
position reaches the width.

Shards with very many different fragments are not gathered: relative grams
that occur once trim their windows, and the rest are ordered by the rank name
of the whole window through plain aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, merge_spans, mix64, pinned, row_spans

WIDTH = 400
GRAM = 16
# Windows of one fragment at most; longer runs (periodic text) are cut.
FRAGMENT_WINDOWS = 2048
# Different fragments of one gram that one task may order together.
SHARD_FRAGMENTS = 4096
# Text that one suffix array covers at least; small shards share one.
CHUNK_BYTES = 1 << 20
# Distance of the grams that trim crowded shards.
TRIM_EVERY, TRIM_GRAM = 32, 32
# Bits of the filter that tells which texts must travel to their spans; full, it lets all of them through.
FILTER_BITS = 1 << 25


def _loads(text: bytes) -> np.ndarray:
    """The 8 bytes at every position, as uint64 (zeros after the end)."""
    raw = text + b"\0" * 8
    return np.ndarray((len(text) + 1,), np.dtype("<u8"), raw, 0, (1,))


def gram_hashes(text: bytes) -> np.ndarray:
    x = _loads(text)
    n = len(text) - GRAM + 1
    return mix64(mix64(x[:n]) ^ (x[GRAM - 8 : GRAM - 8 + n] * np.uint64(0x9E3779B97F4A7C15)))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Smallest hash of each run of ``width`` hashes, from block-wise running minima."""
    n = len(hashes)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = hashes
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(behind[:k], ahead[width - 1 : width - 1 + k])


def fragments(text: bytes, width: int = WIDTH) -> Iterator[tuple[int, int, int, int, bool]]:
    """(gram key, content hash, first window, windows, whether the gram repeats inside) of a text."""
    if len(text) < width:
        return
    hashes = gram_hashes(text)
    span = width - GRAM + 1
    low = window_minima(hashes, span)
    cuts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        tied = np.count_nonzero(hashes[a : b - 1 + span] == low[a]) > 1
        for start in range(a, b, FRAGMENT_WINDOWS):
            n = min(b, start + FRAGMENT_WINDOWS) - start
            body = text[start : start + n + width - 1]
            yield int(low[a]) - 2**63, xxhash.xxh3_64_intdigest(body) - 2**63, start, n, tied


def repeated_windows(texts: list[bytes], width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text two flags for each window: it occurs earlier; it occurs at all elsewhere in ``texts``.

    Suffixes are ordered by rank doubling: 25, 50, ... bytes up to the width.
    Only places whose prefix still has an equal stay in the order. Earlier
    means at a smaller position of the concatenated texts.
    """
    steps, length = [], width
    while length % 2 == 0 and length > 32:
        length //= 2
        steps.append(length)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    body = b"".join(texts)
    ends = np.repeat(begins + sizes, sizes)
    x = _loads(body)
    # Ranks of the first ``length`` bytes: their hash is as good an order as any.
    place = np.arange(len(body))
    place = place[place + length <= ends]
    key = np.zeros(len(place), np.uint64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        key = mix64(key ^ x[place + at]) * np.uint64(0x9E3779B97F4A7C15)
    rank = np.full(len(body), -1, np.int64)
    for step in [*reversed(steps), None]:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        alone = np.bincount(number, minlength=1)[number] == 1 if len(key) else np.empty(0, bool)
        order, number = order[~alone], number[~alone]
        place = place[order]
        rank.fill(-1)
        rank[place] = number
        if step is None:
            break
        place = np.sort(place)
        place = place[place + 2 * step <= ends[place]]
        follow = rank[place + step]
        place, follow = place[follow >= 0], follow[follow >= 0]
        key = rank[place] * np.int64(len(body) + 1) + follow
    # Now in suffix order; the sort is stable, so equal prefixes stand by position:
    # the neighbour above is the previous smaller position, the one below the next.
    same = number[1:] == number[:-1] if len(number) else np.empty(0, bool)
    earlier, anywhere = np.zeros(len(body), bool), np.zeros(len(body), bool)
    earlier[place[1:][same]] = True
    anywhere[place] = True
    return [(earlier[b : b + n - width + 1], anywhere[b : b + n - width + 1]) for b, n in zip(begins, sizes, strict=True)]


def _flat(flags: np.ndarray) -> list[int]:
    return row_spans(flags).ravel().tolist()


FOUND = "key bigint, h bigint, earlier array<int>, anywhere array<int>"


def _order_shards(rows: DataFrame, width: int) -> DataFrame:
    """Window flags (runs of window numbers) of the fragments, key by key in sorted partitions."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None

        def done() -> pd.DataFrame:
            # Place order of the corpus becomes position order of the array.
            pdf = pd.concat(held).sort_values(["row", "start"])
            flags = repeated_windows(pdf["body"].tolist(), width)
            return pd.DataFrame({
                "key": pdf["key"].to_numpy(), "h": pdf["h"].to_numpy(),
                "earlier": [_flat(e) for e, _ in flags], "anywhere": [_flat(a) for _, a in flags],
            })

        for pdf in frames:
            for key, part in pdf.groupby("key", sort=False):
                if key != last and size >= CHUNK_BYTES:
                    yield done()
                    held, size = [], 0
                held.append(part)
                size += int(part["body"].map(len).sum())
                last = key
        if held:
            yield done()

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(solve, FOUND)


def _order_crowded(rows: DataFrame, width: int) -> DataFrame:
    """The same for keys with too many fragments for one task, without gathering a key.

    Fragments of a key are aligned on its gram, on every place of it where a
    fragment has it more than once. Grams at fixed distances from there are
    counted by (key, distance, gram): a window over one that occurs once is
    unique. The windows left are named by a 128-bit hash and counted by name,
    with partial aggregation throughout.
    """

    def samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, h, body in zip(pdf["key"], pdf["h"], pdf["body"], strict=True):
                found = set()
                for at in _anchors(body, key).tolist():
                    # No window over the gram reaches farther.
                    low = at - min(at, width) // TRIM_EVERY * TRIM_EVERY
                    for p in range(low, min(len(body) - TRIM_GRAM, at + width) + 1, TRIM_EVERY):
                        found.add((p - at, xxhash.xxh3_64_intdigest(body[p : p + TRIM_GRAM]) - 2**63))
                out += [(key, h, far, gram) for far, gram in found]
            yield pd.DataFrame(out, columns=["key", "h", "far", "gram"])

    grams = rows.mapInPandas(samples, "key bigint, h bigint, far int, gram bigint")
    common = grams.groupBy("key", "far", "gram").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    # Distances at which a fragment holds a gram of its own: a short list each.
    lone = grams.join(common, ["key", "far", "gram"]).groupBy("key", "h").agg(F.collect_list("far").alias("own"))

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, h, row, start, body, own, tied in zip(
                *(pdf[c] for c in ("key", "h", "row", "start", "body", "own", "tied")), strict=True
            ):
                free = np.ones(len(body) - width + 1, bool)
                at = int(_anchors(body, key)[0])
                # A tied fragment's windows may hang on any place of the gram: none of them is struck out.
                for far in () if own is None or tied else own:
                    p = at + int(far)
                    free[max(0, p + TRIM_GRAM - width) : p + 1] = False
                for i in np.flatnonzero(free).tolist():
                    d = xxhash.xxh3_128_digest(body[i : i + width])
                    out.append((key, h, i, d, row, start + i))
            yield pd.DataFrame(out, columns=["key", "h", "i", "name", "row", "place"])

    trimmed = rows.join(lone, ["key", "h"], "left")
    named = trimmed.mapInPandas(name, "key bigint, h bigint, i int, name binary, row bigint, place bigint")
    classes = named.groupBy("key", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("first")
    ).filter("n > 1")
    hits = named.join(classes, ["key", "name"]).withColumn(
        "later", (F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place"))
    )
    # One fragment's windows: at most FRAGMENT_WINDOWS of them.
    per = hits.groupBy("key", "h").agg(
        F.sort_array(F.collect_list(F.when(F.col("later"), F.col("i")))).alias("earlier"),
        F.sort_array(F.collect_list("i")).alias("anywhere"),
    )

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for c in ("earlier", "anywhere"):
                pdf[c] = [_number_runs(np.asarray(v, np.int64)) for v in pdf[c]]
            yield pdf

    return per.mapInPandas(runs, FOUND)


def _anchors(body: bytes, key: int) -> np.ndarray:
    """Places of the fragment's smallest gram."""
    return np.flatnonzero(gram_hashes(body) == np.uint64(key + 2**63))


def _number_runs(numbers: np.ndarray) -> list[int]:
    if not len(numbers):
        return []
    breaks = np.flatnonzero(np.diff(numbers) != 1)
    return np.stack(
        (numbers[np.concatenate(([0], breaks + 1))], numbers[np.append(breaks, len(numbers) - 1)] + 1), axis=1
    ).ravel().tolist()


def repeat_spans(rows: DataFrame, width: int = WIDTH, shard_fragments: int = SHARD_FRAGMENTS) -> DataFrame:
    """Byte spans of repeats for rows (row, text binary): row, begin, end, later.

    Each span is a run of windows that occur elsewhere; ``later`` marks spans
    whose windows all have an earlier copy in (row, place) order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "row", "start", "windows", "tied"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            found = [
                (key, h, row, start, n, bool(tied))
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for key, h, start, n, tied in fragments(text, width)
            ]
            columns = zip(*found, strict=True) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    places = pinned(rows.mapInArrow(cut, "key bigint, h bigint, row bigint, start int, windows int, tied boolean"))
    distinct = places.groupBy("key", "h").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("first"),
        F.first("windows").alias("windows"), F.first("tied").alias("tied"),
    )
    # Keys of a single fragment end here; the rest of the work sees repeats only.
    keys = distinct.groupBy("key").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all"), F.max("tied").alias("any_tied")
    ).filter("all > 1 or any_tied").drop("all", "any_tied")
    shared = pinned(distinct.join(keys, "key"))
    mixed = shared.filter("kinds > 1 or tied")
    wanted = mixed.groupBy("first.row").agg(
        F.collect_list(F.struct("key", "h", F.col("first.start").alias("start"), "windows", "tied", "kinds")).alias("parts")
    )
    bodies = (
        rows.join(wanted, "row").select("row", "text", F.explode("parts").alias("p"))
        .select("row", "p.key", "p.h", "p.start", "p.tied", "p.kinds",
                F.substring("text", F.col("p.start") + 1, F.col("p.windows") + width - 1).alias("body"))
    )
    crowded = mixed.filter(F.col("kinds") > shard_fragments).limit(1).count() > 0
    if crowded:
        bodies = pinned(bodies)
    flags = _order_shards(bodies.filter(F.col("kinds") <= shard_fragments).drop("kinds", "tied"), width)
    if crowded:
        flags = flags.unionByName(_order_crowded(bodies.filter(F.col("kinds") > shard_fragments).drop("kinds"), width))
    known = shared.join(flags, ["key", "h"], "left").select("key", "h", "copies", "first", "earlier", "anywhere")
    known = known.filter((F.col("copies") > 1) | (F.size("anywhere") > 0))
    met = places.join(known, ["key", "h"])
    here = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    whole = F.array(F.lit(0), F.col("windows"))
    nothing = F.array().cast("array<int>")
    later = F.when(here, F.coalesce("earlier", nothing)).otherwise(whole)
    anywhere = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("anywhere", nothing))
    parts = met.select(
        "row", "start", F.explode(F.array(F.struct(F.lit(True).alias("later"), later.alias("runs")),
                                          F.struct(F.lit(False).alias("later"), anywhere.alias("runs")))).alias("x"),
    )
    runs = parts.select("row", "start", "x.later", F.col("x.runs").alias("runs")).filter(F.size("runs") > 0)
    pair = F.explode(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)))
    return runs.select("row", "start", "later", "runs", pair.alias("k")).select(
        "row", (F.col("start") + F.get("runs", F.col("k"))).cast("bigint").alias("begin"),
        (F.col("start") + F.get("runs", F.col("k") + 1) + width - 1).cast("bigint").alias("end"), "later",
    )


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with marked: true for every row number of ``wanted``, and by chance for a few others.

    The numbers' hashes are set in bitmaps of bounded size together, which are
    broadcast; so rows that are not marked need no exchange.
    """
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    place = wanted.select(bit.alias("bit"))
    bits = place.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bucket"), "left").select(
        *rows.columns, hit.alias("marked")
    )


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: str = "none", shard_fragments: int = SHARD_FRAGMENTS) -> DataFrame:
    """Documents without their repeated substrings: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    ``keep="none"`` removes every byte under a ``width``-byte string that also
    starts elsewhere in the corpus, ``keep="first"`` only where an earlier copy
    (in row order, then position) exists. Matches never cross documents. Null
    texts count as empty; texts shorter than the width lose nothing; rows
    repeated under one doc_id are documents of their own; an empty table gives
    no rows; other columns are ignored. ``docs`` is scanned more than once and
    must give its rows in the same order each time, as a table read does.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    spans = repeat_spans(rows.select("row", "text"), width, shard_fragments).filter("later" if keep == "first" else "not later")
    # A document's own spans only: the list is as long as the document at most.
    cuts = spans.groupBy("row").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, begins, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "begins", "ends")), strict=True):
                merged = merge_spans(np.array([begins or [], ends or []], np.int64).T)
                left, at = [], 0
                for b, e in merged.tolist():
                    left.append(text[at:b])
                    at = e
                kept = b"".join([*left, text[at:]])
                for column, value in zip(
                    out, (len(text), len(text) - len(kept), len(merged), kept, hashlib.sha256(kept).hexdigest()), strict=True
                ):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", *names]
            )

    # Texts without spans stay where they were read.
    cuts = pinned(cuts)
    marked = _marked(rows, cuts)
    spanless = F.lit(None).cast("array<bigint>")
    stay = marked.filter(~F.col("marked")).select("doc_id", "text", spanless.alias("begins"), spanless.alias("ends"))
    moved = marked.filter("marked").join(cuts, "row", "left").select("doc_id", "text", "begins", "ends")
    return stay.union(moved).mapInArrow(
        remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    )
