"""Joins: label manifests, address ranges, scan results, processed files."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.ip import is_public_ip, normalize_ip, v4_number, v6_hex
from packetloom.functions.labels import file_name, file_stem
from packetloom.operators.sizing import small

# IPv4 addresses in their mapped form, as numbers of 128 bits.
MAPPED = 0xFFFF << 32
# Blocks of ranges that a task gathers before it hands them on.
BLOCK_ROWS = 50_000


def manifest_labels(
    rows: DataFrame, path_col: str, manifest: DataFrame, default: str = "BENIGN", out: str = "label"
) -> DataFrame:
    """JON1: label by file name, else stem, else full path, else the default.

    The manifest has one row per file; only distinct paths look it up.
    """
    table = manifest.groupBy("file").agg(F.max("label").alias("label"))
    table = small(table)
    paths = rows.select(F.col(path_col).alias("__path")).distinct()
    ways = {"__by_name": file_name(F.col("__path")), "__by_stem": file_stem(F.col("__path")), "__by_path": F.col("__path")}
    for name, key in ways.items():
        hit = table.select(F.col("file").alias(f"{name}_key"), F.col("label").alias(name))
        paths = paths.join(hit, key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    labelled = paths.select("__path", F.coalesce(*[F.col(w) for w in ways], F.lit(default)).alias(out))
    return rows.join(small(labelled), F.col(path_col).eqNullSafe(F.col("__path")), "left").drop("__path")


def _bucketed(ranges: DataFrame) -> DataFrame:
    """One row per /16 block a range touches. Ranges do not overlap, so this
    adds at most 65,536 rows to the table."""
    return ranges.withColumn("__block", F.explode(F.expr("sequence(ip_lo div 65536, ip_hi div 65536)")))


def geo_enrich(events: DataFrame, ip_col: str, ranges: DataFrame, attributes: list[str]) -> DataFrame:
    """JON4: attributes of the address range holding each client address.

    Small range tables (checked) are broadcast and the events never move.
    Otherwise the distinct addresses look the ranges up first, as a cache
    would, and the result joins back by address.
    """
    blocks = _bucketed(ranges.select("ip_lo", "ip_hi", *attributes))
    hinted = small(blocks)
    address = events.withColumn("geo_ip", normalize_ip(F.col(ip_col)))

    def look_up(df: DataFrame) -> DataFrame:
        number = F.when(is_public_ip(F.col("geo_ip")), v4_number(F.col("geo_ip")))
        keyed = df.withColumn("__num", number).withColumn("__b", F.expr("__num div 65536"))
        match = (F.col("__b") == F.col("__block")) & F.col("__num").between(F.col("ip_lo"), F.col("ip_hi"))
        return keyed.join(hinted, match, "left").drop("__num", "__b", "__block", "ip_hi")

    if hinted is not blocks:
        joined = look_up(address)
    else:
        found = look_up(address.select("geo_ip").where(F.col("geo_ip").isNotNull()).distinct())
        joined = address.join(found, "geo_ip", "left")
    reason = (
        F.when(F.col("geo_ip").isNull(), F.lit("missing_or_invalid_ip"))
        .when(~is_public_ip(F.col("geo_ip")), F.lit("non_public_ip"))
        .when(F.col("ip_lo").isNull(), F.lit("not_found"))
    )
    return joined.withColumns(
        {
            "geo_provider": F.lit(K.GEO_PROVIDER),
            "geo_resolved": F.col("ip_lo").isNotNull(),
            "geo_reason": reason,
        }
    ).drop("ip_lo")


def _near(single: DataFrame, single_ts: str, copied: DataFrame, copied_ts: str, width: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides keyed by (trace, time bucket) and the condition of the join.

    The single side lies in one bucket of the window's length, the copied one
    in the three around its own, so every pair within the window meets once and
    a row of the single side is never doubled.
    """
    one = single.withColumnRenamed("trace_id", "__trace").withColumn("__b", F.expr(f"floor(unix_micros({single_ts}) / {width}D)"))
    here = f"floor(unix_micros({copied_ts}) / {width}D)"
    many = copied.withColumnRenamed("trace_id", "__copied").withColumn("__cb", F.explode(F.expr(f"sequence({here} - 1L, {here} + 1L)")))
    low, high = (F.expr(f"{single_ts} {sign} INTERVAL {width} MICROSECONDS") for sign in "-+")
    near = (F.col("__trace") == F.col("__copied")) & (F.col("__b") == F.col("__cb")) & F.col(copied_ts).between(low, high)
    return one, many, near


def _aligned(low: str, high: str) -> tuple[int, int, list[tuple[int, int]]] | None:
    """First address, width and (bits, first address) of the whole-prefix blocks of a range, as numbers of 128 bits.

    None for what is no address, of two families or the wrong way round.
    """
    try:
        a, z = ipaddress.ip_address(low), ipaddress.ip_address(high)
        if a.version != z.version or a > z:
            return None
    except (ValueError, TypeError):
        return None
    lift = MAPPED if a.version == 4 else 0
    at, end, blocks = int(a) + lift, int(z) + lift, []
    first, width = at, end - at
    while at <= end:
        # The largest block that begins here: by the zeros the address ends in and by what is left of the range.
        size = min((at & -at).bit_length() - 1 if at else 128, (end - at + 1).bit_length() - 1)
        blocks.append((128 - size, at))
        at += 1 << size
    return first, width, blocks


def _spread(ranges: DataFrame) -> DataFrame:
    """A range table is small before its ranges are cut, and would be cut by the one task that reads its file."""
    return ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism)


def prefix_lengths(ranges: DataFrame) -> list[int]:
    """The lengths of all blocks of ``prefix_blocks``, ascending; 129 at most."""

    def lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for pdf in frames:
            for low, high in zip(pdf["ip_lo"], pdf["ip_hi"], strict=True):
                cut = _aligned(low, high)
                met.update(bits for bits, _ in cut[2]) if cut else None
        yield pd.DataFrame({"bits": sorted(met)}, dtype="int32")

    found = _spread(ranges.select("ip_lo", "ip_hi")).mapInPandas(lengths, "bits int")
    return sorted(r[0] for r in found.distinct().collect())


def prefix_blocks(ranges: DataFrame, attributes: list[str]) -> DataFrame:
    """(bits, prefix, width, low, attributes) of address ranges given as texts ``ip_lo`` and ``ip_hi``, both families.

    A range falls into blocks of whole prefixes, 254 at most. Addresses are 32
    hex digits, IPv4 in its mapped form; ``prefix`` is the block's first
    address. Ranges that are no addresses, of two families or the wrong way
    round are dropped. Only the range table runs through this, and a task holds
    about ``BLOCK_ROWS`` blocks at a time.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:

            def frame(at: list[int], out: list[tuple], pdf: pd.DataFrame = pdf) -> pd.DataFrame:
                cut = pd.DataFrame(out, columns=["bits", "prefix", "width", "low"])
                return pd.concat([cut, pdf[attributes].iloc[at].reset_index(drop=True)], axis=1)

            at, out = [], []
            for i, (low, high) in enumerate(zip(pdf["ip_lo"], pdf["ip_hi"], strict=True)):
                if (cut := _aligned(low, high)) is None:
                    continue
                first, width = f"{cut[0]:032x}", f"{cut[1]:032x}"
                out += [(bits, f"{prefix:032x}", width, first) for bits, prefix in cut[2]]
                at += [i] * len(cut[2])
                if len(out) >= BLOCK_ROWS:
                    yield frame(at, out)
                    at, out = [], []
            yield frame(at, out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.select(*attributes).schema)
    return _spread(ranges.select("ip_lo", "ip_hi", *attributes)).mapInPandas(
        split, f"bits int, prefix string, width string, low string, {kinds}"
    )


def _first_of_block(digits: Column, bits: Column) -> Column:
    """The first address of the block of ``bits`` bits that holds an address of 32 hex digits."""
    whole, part = F.shiftright(bits, 2), bits % 4
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    masked = F.when(part > 0, F.lower(F.hex(digit - digit % F.pow(F.lit(2), 4 - part).cast("int")))).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substring(digits, F.lit(1), whole), masked), 32, "0")


def geo_enrich_any(events: DataFrame, ip_col: str, ranges: DataFrame, attributes: list[str]) -> DataFrame:
    """JON4 for both address families and nested or overlapping ranges (text ``ip_lo`` to ``ip_hi``).

    The narrowest range that holds an address counts, of equal ones the lowest.
    Each distinct text is read once, and each distinct public address asks once
    per prefix length that the table has (128 at most), by equi-joins on the
    block's first address, so neither side is broadcast or sorted whole; what
    many addresses share, such as a short prefix, is one row on the table's
    side. The planner judges the blocks by the table they are cut from, a
    hundredth of their size, and addresses by their compressed size, so hints
    keep it from broadcasting either through the driver.
    """
    lengths = prefix_lengths(ranges)
    blocks = prefix_blocks(ranges, attributes).hint("merge")
    address = events.withColumn("__raw", F.col(ip_col))
    digits = F.when(
        F.contains("geo_ip", F.lit(":")), v6_hex(F.col("geo_ip"))
    ).otherwise(F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(v4_number(F.col("geo_ip")))), 8, "0")))
    # Exploded, as filters on what is read would else run below the distinct, on every event and several times.
    texts = address.select("__raw").where(F.col("__raw").isNotNull()).distinct().select(
        "__raw", F.explode(F.array(normalize_ip(F.col("__raw")))).alias("geo_ip")
    )
    asked = texts.select("geo_ip").where(F.col("geo_ip").isNotNull()).distinct().where(is_public_ip(F.col("geo_ip")))
    asked = asked.withColumn("__digits", digits).withColumn("bits", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    asked = asked.withColumn("prefix", _first_of_block(F.col("__digits"), F.col("bits")))
    found = asked.join(blocks, ["bits", "prefix"]).groupBy("geo_ip").agg(
        F.min(F.struct("width", "low", *attributes)).alias("__hit")
    ).withColumn("__known", F.lit(True))
    known = texts.withColumn("__public", is_public_ip(F.col("geo_ip"))).join(found.hint("merge"), "geo_ip", "left")
    joined = address.drop("geo_ip").join(known.hint("merge"), "__raw", "left").select(
        "geo_ip", *[c for c in events.columns if c != "geo_ip"], "__public", "__hit", "__known"
    ).withColumns({a: F.col("__hit")[a] for a in attributes})
    reason = (
        F.when(F.col("geo_ip").isNull(), F.lit("missing_or_invalid_ip"))
        .when(~F.col("__public"), F.lit("non_public_ip"))
        .when(F.col("__known").isNull(), F.lit("not_found"))
    )
    return joined.withColumns(
        {"geo_provider": F.lit(K.GEO_PROVIDER), "geo_resolved": F.col("__known").isNotNull(), "geo_reason": reason}
    ).drop("__public", "__hit", "__known")


def merge_with_scans(detections: DataFrame, scans: DataFrame, window_seconds: int, how: str = "inner") -> DataFrame:
    """JON3: detections and scans of one trace at most ``window_seconds`` apart; inner, left, right or full.

    Time buckets of the window length join the trace as equi keys, so even a
    trace holding most rows spreads over many tasks. The side that an outer
    join preserves is never copied; ``full`` adds the scans without a partner
    to the left join. Rows without a trace or time have no partner.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join: {how}")
    width = window_seconds * 1_000_000
    names = [*detections.columns, *(c for c in scans.columns if c != "trace_id")]
    if how == "right":
        one, many, near = _near(scans, "scan_ts", detections, "ts", width)
    else:
        one, many, near = _near(detections, "ts", scans, "scan_ts", width)
    joined = one.join(many, near, "inner" if how == "inner" else "left").withColumnRenamed("__trace", "trace_id").select(*names)
    if how != "full":
        return joined
    one, many, near = _near(scans, "scan_ts", detections, "ts", width)
    alone = one.join(many, near, "left_anti").withColumnRenamed("__trace", "trace_id")
    return joined.unionByName(alone.drop("__b"), allowMissingColumns=True).select(*names)


def merge_scan_streams(detections: DataFrame, scans: DataFrame, window_seconds: int, delay: str, how: str = "inner") -> DataFrame:
    """JON3 on two streams: pairs of one trace within the window; inner, left or right.

    Both sides carry a watermark of ``delay``; with the window they bound how
    long a row can wait for a partner, and state beyond that is dropped. The
    time bucket is part of the key, so a trace of most rows spreads over tasks.
    Rows of the preserved side without a partner come out once no partner can
    come any more; rows without a time are dropped.
    """
    if how not in ("inner", "left", "right"):
        raise ValueError(f"unknown stream join: {how}")
    width = window_seconds * 1_000_000
    names = [*detections.columns, *(c for c in scans.columns if c != "trace_id")]
    sides = (detections.withWatermark("ts", delay).where("ts IS NOT NULL"), "ts", scans.withWatermark("scan_ts", delay).where("scan_ts IS NOT NULL"), "scan_ts")
    one, many, near = _near(*(sides[2:] + sides[:2] if how == "right" else sides), width)
    joined = one.join(many, near, "inner" if how == "inner" else "leftOuter")
    return joined.withColumnRenamed("__trace", "trace_id").select(*names)


def unprocessed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """JON6: files that are not in the manifest of processed ones."""
    return files.join(done.select(key), key, "left_anti")
