"""Packet captures to packet rows.

Spark lists the files and spreads byte ranges over tasks; a task walks the
record headers of its own range and decodes all packets of a batch at once
with array operations. Only Ethernet frames with IPv4 / IPv6 and TCP / UDP
yield rows; everything else is skipped.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom.functions.labels import file_stem
from packetloom.operators.sizing import small
from packetloom.session import ensure_checkpoint_dir

CHUNK_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024
RESYNC_RECORDS = 16
MAX_RECORD = 262_144
FILE_HEADER = 24
RECORD_HEADER = 16
# Ranges that a walk over unproved ground passes before it is taken up by another task.
REACH = 256

# Capture magics -> (byte order, fraction units per microsecond)
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
RAW_SCHEMA = (
    "path string, pkt_no bigint, ts_us bigint, src_v4 bigint, src_v6 string, src_port int, dst_v4 bigint, "
    "dst_v6 string, dst_port int, proto int, hdr_len int, pkt_len int, tcp_flags int, tcp_win int"
)
# Packets with the stretch they belong to, and one row without a packet per
# stretch: where it begins (null: nowhere) and where the next one would.
STRETCHES = "part bigint, entry bigint, next bigint"


def _open(path: str):
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def _layout(stream) -> tuple[str, int] | None:
    """(byte order, fraction units) or None for a file that is no capture."""
    return MAGICS.get(stream.read_at(4, 0))


def _plausible(data: bytes, at: int, order: str, near: int | None) -> tuple[int, int] | None:
    """(next offset, seconds) when the 16 bytes at ``at`` can be a record header."""
    sec, frac, cap, full = struct.unpack_from(order + "IIII", data, at)
    if not 14 <= cap <= MAX_RECORD or cap > full or full > MAX_RECORD or frac >= 1_000_000_000:
        return None
    if near is not None and abs(sec - near) > 86_400:
        return None
    return at + RECORD_HEADER + cap, sec


def _resync(data: bytes, order: str, at_end: bool) -> int | None:
    """First offset from which a long chain of records parses."""
    for start in range(max(0, len(data) - RECORD_HEADER)):
        at, near, links = start, None, 0
        while links < RESYNC_RECORDS and at + RECORD_HEADER <= len(data):
            step = _plausible(data, at, order, near)
            if step is None:
                break
            at, near = step
            links += 1
        if links == RESYNC_RECORDS or (links > 0 and at_end and at == len(data)):
            return start
    return None


def _walk(stream, order: str, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """(block offset, block, record offsets in the block) until a record at or past ``stop``.

    The block grows until the next record fits, and the last one ends a record
    behind ``stop``. A record that reaches past the file's end is cut short
    there, as the file is.
    """
    at, block = start, 0
    while at < stop:
        data = stream.read_at(min(block or min(BLOCK_BYTES, stop - at + RECORD_HEADER + MAX_RECORD), size - at), at)
        offsets, pos = [], 0
        while at + pos < stop and pos + RECORD_HEADER <= len(data):
            cap = struct.unpack_from(order + "I", data, pos + 8)[0]
            if pos + RECORD_HEADER + cap > len(data) and at + len(data) < size:
                break
            offsets.append(pos)
            pos += RECORD_HEADER + cap
        if not offsets:
            if at + len(data) >= size:
                return
            cap = struct.unpack_from(order + "I", data, 8)[0]
            block = max(2 * len(data), RECORD_HEADER + cap)
            continue
        yield at, data, offsets
        at, block = at + pos, 0


def _stretch(stream, path: str, layout: tuple[str, int], part: int, entry: int, stop: int, size: int, others: np.ndarray) -> Iterator[pd.DataFrame]:
    """Packets from ``entry`` to the first record at or past ``stop`` or among ``others``, then the stretch's own row."""
    order, unit = layout
    at_end = entry
    for at, data, offsets in _walk(stream, order, entry, stop, size):
        met = np.flatnonzero(np.isin(np.asarray(offsets, dtype=np.int64) + at, others))
        inside = offsets[: met[0]] if len(met) else offsets
        if inside:
            yield _decode(path, at, data, inside, order, unit).assign(part=part, entry=entry, next=None)
        if len(met):
            at_end = at + offsets[met[0]]
            break
        at_end = at + offsets[-1] + RECORD_HEADER + struct.unpack_from(order + "I", data, offsets[-1] + 8)[0]
    yield _own_row(path, part, entry, at_end if entry < at_end <= size - RECORD_HEADER else None)


def _own_row(path: str, part: int, entry: int | None, following: int | None) -> pd.DataFrame:
    row = {"path": path, "part": part, "entry": entry, "next": following}
    names = [field.split()[0] for field in f"{RAW_SCHEMA}, {STRETCHES}".split(", ")]
    return pd.DataFrame({n: pd.Series([row.get(n)], dtype=object) for n in names})


def _speculate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Guess the first record of each range and decode from there to the next range."""
    for batch in batches:
        for path, part, lo, hi, size in batch[["path", "part", "lo", "hi", "size"]].itertuples(index=False):
            with _open(path) as stream:
                if (layout := _layout(stream)) is None:
                    continue
                entry = FILE_HEADER
                if part > 0:
                    probe = stream.read_at(min(4 * MAX_RECORD, size - lo), lo)
                    found = _resync(probe, layout[0], lo + len(probe) == size)
                    entry = hi if found is None else lo + found
                if entry < hi:
                    yield from _stretch(stream, path, layout, part, entry, hi, size, np.empty(0, dtype=np.int64))
                else:
                    yield _own_row(path, part, None, None)


def _read_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decode from where a stretch ended without a guess until a guess is met."""
    for batch in batches:
        for path, part, entry, stop, size, guesses in batch[["path", "part", "entry", "stop", "size", "guesses"]].itertuples(index=False):
            with _open(path) as stream:
                others = np.asarray([] if guesses is None else guesses, dtype=np.int64)
                yield from _stretch(stream, path, _layout(stream), part, entry, stop, size, others)


def _off_chain(stretches: pd.DataFrame) -> pd.DataFrame:
    """Stretches of one file that the chain of records from the file's header does not pass."""
    following = dict(zip(stretches["entry"], stretches["next"], strict=True))
    at, passed = FILE_HEADER, set()
    while at in following and at not in passed:
        passed.add(at)
        at = following[at]
    return stretches.loc[~stretches["entry"].isin(passed), ["path", "entry"]]


def _cut_packets(cut: DataFrame, chunk: int) -> DataFrame:
    """Raw packets of the ranges (path, part, lo, hi, size) of large files.

    Every range is decoded once from the record that is guessed to be its
    first. A stretch that ends where no other begins is read on, all such
    places at once, until it meets a guess. Then each file's chain of stretches
    from its header tells which of them hold; packets of the others go.
    """
    ensure_checkpoint_dir(cut.sparkSession)
    spread = max(cut.sparkSession.sparkContext.defaultParallelism, 1) * 4
    schema = f"{RAW_SCHEMA}, {STRETCHES}"
    read = cut.repartition(spread, "path", "part").mapInPandas(_speculate, schema).checkpoint()
    own = read.where("pkt_no IS NULL").select("path", "part", "entry", "next")
    ahead = W.partitionBy("path").orderBy("part").rowsBetween(0, REACH - 1)
    guesses = own.select("path", "part", F.collect_list("entry").over(ahead).alias("guesses"))
    sizes = cut.where("part = 0").select("path", "size")
    stretches = own.where("entry IS NOT NULL").select("path", "entry", "next")
    while True:
        ends = stretches.where("next IS NOT NULL").select("path", F.col("next").alias("entry")).distinct()
        loose = ends.join(stretches, ["path", "entry"], "left_anti").checkpoint()
        if loose.isEmpty():
            break
        part = F.expr(f"entry div {chunk}L")
        taken = loose.withColumn("part", part).join(sizes, "path").join(guesses, ["path", "part"], "left")
        taken = taken.withColumn("stop", F.least("size", (F.col("part") + REACH) * chunk))
        more = taken.repartition(spread, "path", "entry").mapInPandas(_read_on, schema).checkpoint()
        stretches = stretches.unionByName(more.where("pkt_no IS NULL").select("path", "entry", "next"))
        read = read.unionByName(more)
    wrong = stretches.groupBy("path").applyInPandas(_off_chain, "path string, entry bigint")
    packets = read.where("pkt_no IS NOT NULL").join(small(wrong), ["path", "entry"], "left_anti")
    return packets.drop("part", "entry", "next")


def _be16(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (_at(data, at) << 8) | _at(data, at + 1)


def _at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[np.clip(at, 0, len(data) - 1)].astype(np.int64)


def _v6_text(data: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Address texts of the packets in ``mask``; each different address is written once."""
    out = np.full(len(at), None, dtype=object)
    if mask.any():
        raw = np.ascontiguousarray(data[at[mask][:, None] + np.arange(16)]).view("V16").ravel()
        different, place = np.unique(raw, return_inverse=True)
        texts = np.array([socket.inet_ntop(socket.AF_INET6, a.tobytes()) for a in different], dtype=object)
        out[mask] = texts[place]
    return out


def _decode(path: str, base: int, block: bytes, offsets: list[int], order: str, unit: int) -> pd.DataFrame:
    data = np.frombuffer(block, dtype=np.uint8)
    rec = np.asarray(offsets, dtype=np.int64)
    words = np.stack([data[rec + k] for k in range(RECORD_HEADER)], axis=1).copy().view(np.dtype("u4").newbyteorder(order))
    sec, frac, cap = (words[:, k].astype(np.int64) for k in range(3))
    start = rec + RECORD_HEADER
    end = np.minimum(start + cap, len(data))
    l3 = start + 14
    kind = _be16(data, start + 12)
    # Stacked VLAN tags, as many as there are.
    while (tagged := np.isin(kind, (0x8100, 0x88A8, 0x9100)) & (l3 + 4 <= end)).any():
        kind = np.where(tagged, _be16(data, l3 + 2), kind)
        l3 = np.where(tagged, l3 + 4, l3)
    version = _at(data, l3) >> 4
    v4 = (kind == 0x0800) & (version == 4) & (l3 + 20 <= end)
    v6 = (kind == 0x86DD) & (version == 6) & (l3 + 40 <= end)

    ihl = (_at(data, l3) & 15) * 4
    total = _be16(data, l3 + 2)
    whole4 = v4 & (ihl >= 20) & ((_be16(data, l3 + 6) & 0x1FFF) == 0)
    plen = _be16(data, l3 + 4)
    l4 = np.where(v4, l3 + ihl, l3 + 40)
    proto = np.where(v4, _at(data, l3 + 9), _at(data, l3 + 6))
    whole6 = v6.copy()
    # IPv6 extension headers, as many as there are.
    while (ext := v6 & np.isin(proto, (0, 43, 60, 44, 51)) & (l4 + 8 <= end)).any():
        fragment = ext & (proto == 44)
        whole6 &= ~(fragment & ((_be16(data, l4 + 2) >> 3) != 0))
        length = np.where(proto == 44, 8, np.where(proto == 51, (_at(data, l4 + 1) + 2) * 4, (_at(data, l4 + 1) + 1) * 8))
        proto = np.where(ext, _at(data, l4), proto)
        l4 = np.where(ext, l4 + length, l4)
    limit4 = np.where(total > 0, l3 + total, end)
    limit6 = np.where(plen > 0, l3 + 40 + plen, end)
    l4_len = np.minimum(np.where(v4, limit4, limit6), end) - l4

    tcp = proto == 6
    off_flags = _be16(data, l4 + 12)
    tcp_header = (off_flags >> 12) * 4
    good = np.where(tcp, (l4_len >= 20) & (tcp_header >= 20), (proto == 17) & (l4_len >= 8))
    keep = (whole4 | whole6) & good
    addr4 = lambda at: (_be16(data, at) << 16) | _be16(data, at + 2)
    frame = pd.DataFrame(
        {
            "path": path,
            "pkt_no": base + rec,
            "ts_us": sec * 1_000_000 + frac // unit,
            "src_v4": pd.Series(addr4(l3 + 12), dtype="Int64").where(v4),
            "src_v6": _v6_text(data, l3 + 8, keep & v6),
            "src_port": _be16(data, l4),
            "dst_v4": pd.Series(addr4(l3 + 16), dtype="Int64").where(v4),
            "dst_v6": _v6_text(data, l3 + 24, keep & v6),
            "dst_port": _be16(data, l4 + 2),
            "proto": proto,
            "hdr_len": np.where(tcp, tcp_header, 8),
            "pkt_len": l4_len,
            "tcp_flags": np.where(tcp, off_flags & 0x1FF, 0),
            "tcp_win": pd.Series(_be16(data, l4 + 14), dtype="Int64").where(tcp),
        }
    )
    return frame[keep]


def _packets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, first, hi, size in batch[["path", "first", "hi", "size"]].itertuples(index=False):
            with _open(path) as stream:
                if (layout := _layout(stream)) is None:
                    continue
                order, unit = layout
                for at, data, offsets in _walk(stream, order, int(first), int(hi), int(size)):
                    if offsets:
                        yield _decode(path, at, data, offsets, order, unit)


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, size in batch[["path", "size"]].itertuples(index=False):
            with _open(path) as stream:
                layout = _layout(stream) if size >= FILE_HEADER else None
                if layout is None:
                    rows.append((path, 0, "no packet capture"))
                    continue
                end = FILE_HEADER
                for at, data, offsets in _walk(stream, layout[0], FILE_HEADER, size, size):
                    if offsets:
                        cap = struct.unpack_from(layout[0] + "I", data, offsets[-1] + 8)[0]
                        end = at + offsets[-1] + RECORD_HEADER + cap
                if end != size:
                    rows.append((path, min(end, size), "cut short" if end > size else "no whole record header"))
        yield pd.DataFrame(rows, columns=["path", "offset", "error"])


def capture_errors(files: DataFrame) -> DataFrame:
    """(path, offset, error) of files (path, size) that are no captures or end inside a record.

    ``packets_of`` passes over the former and keeps what the latter still hold.
    """
    spread = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    return files.repartition(spread * 4, "path").mapInPandas(_faults, "path string, offset bigint, error string")


def _ranges(files: DataFrame, chunk: int) -> DataFrame:
    parts = files.withColumn("part", F.explode(F.expr(f"sequence(0L, (size - 1L) div {chunk}L)")))
    return parts.withColumns(
        {"lo": F.col("part") * chunk, "hi": F.least(F.col("size"), (F.col("part") + 1) * chunk)}
    )


def packets_of(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """SRC5: packet rows of a table of files (path, size).

    A large file is cut into ranges, each decoded from the record that is
    guessed to be its first and kept if the chain of records from the file's
    header passes it; only what that chain reads otherwise is read again. The
    decoded ranges of large files are pinned by a checkpoint on the call.
    """
    ranges = _ranges(files.where(F.col("size") > FILE_HEADER), chunk)
    single = ranges.where(F.col("size") <= chunk).withColumn("first", F.lit(FILE_HEADER).cast("bigint"))
    cut = ranges.where(F.col("size") > chunk)
    spread = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    wanted = single.select("path", "part", "first", "hi", "size")
    raw = wanted.repartition(spread * 4, "path", "part").mapInPandas(_packets, RAW_SCHEMA)
    if not cut.isEmpty():
        raw = raw.unionByName(_cut_packets(cut, chunk))
    text = lambda n: F.concat_ws(
        ".", *[F.shiftright(F.col(n), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )
    address = lambda side: F.when(F.col(f"{side}_v4").isNotNull(), text(f"{side}_v4")).otherwise(
        F.col(f"{side}_v6")
    )
    return raw.select(
        # Equal names in other folders are other captures.
        F.col("path").alias("capture_id"), file_stem(F.col("path")).alias("capture_name"), "pkt_no", F.timestamp_micros("ts_us").alias("ts"),
        address("src").alias("src_ip"), "src_port", address("dst").alias("dst_ip"), "dst_port", "proto", "hdr_len",
        "pkt_len", "tcp_flags", "tcp_win",
    )


def list_captures(spark: SparkSession, path: str, glob: str = "*.[pP][cC][aA][pP]") -> DataFrame:
    """(path, size) of capture files; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("size"))


def read_pcap(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    return packets_of(list_captures(spark, path), chunk)
