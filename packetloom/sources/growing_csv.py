"""STR1: a folder of growing CSV files as a streaming data source.

Spark's file streams read a file once and never look at it again. This source
keeps, per file, the bytes consumed and check sums of the file's beginning.
What a writer appends is read from there on, whole lines only; a file that
shrank or begins otherwise than before was rotated and is read anew. Columns
are matched by name with each file's own header, so their order may differ.

The driver only lists files and looks for line ends; tasks read byte ranges.
"""

from __future__ import annotations

import csv
import json
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_csv"
# Bytes that one task reads of a file's appended part.
RANGE_BYTES = 32 << 20
# Lengths of the beginnings that tell one generation of a file from another.
MARKS = (64, 256, 1024)
BLOCK = 1 << 16
ROWS = 10_000


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(filesystem: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with filesystem.open_input_file(path) as stream:
        return stream.read_at(size, start)


def line_end(filesystem: fs.FileSystem, path: str, low: int, high: int) -> int:
    """Place after the last line break in [low, high); ``low`` if there is none."""
    at = high
    while at > low:
        begin = max(low, at - BLOCK)
        found = _read(filesystem, path, begin, at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return low


def _next_line_end(filesystem: fs.FileSystem, path: str, low: int, high: int) -> int:
    """Place after the first line break in [low, high); ``high`` if there is none."""
    for begin in range(low, high, BLOCK):
        found = _read(filesystem, path, begin, min(BLOCK, high - begin)).find(b"\n")
        if found >= 0:
            return begin + found + 1
    return high


def same_file(before: list, now: list) -> bool:
    """Whether offset entries [consumed, check sums] speak of one generation, the later one not shorter."""
    return now[0] >= before[0] and all(a == b for a, b in zip(before[1], now[1], strict=False))


def advance(
    filesystem: fs.FileSystem, files: list[tuple[str, int]], last: dict[str, list] | None, budget: int | None
) -> dict[str, list]:
    """path -> [consumed, check sums] up to the last whole line of every file (path, size).

    With a ``budget`` in bytes and a known ``last`` offset, files further on in
    the list wait for the next trigger; a line beyond the budget goes whole.
    """
    out: dict[str, list] = {}
    left = budget if budget and last is not None else None
    for path, size in sorted(files):
        known = (last or {}).get(path)
        head = _read(filesystem, path, 0, min(size, MARKS[-1]))
        sums = [zlib.crc32(head[:n]) for n in MARKS if n <= len(head)]
        base = known[0] if known and same_file(known, [size, sums]) else 0
        end = line_end(filesystem, path, base, size)
        if left is not None and end - base > left:
            stop = line_end(filesystem, path, base, base + left)
            end = stop if stop > base or left < budget else _next_line_end(filesystem, path, base + left, end)
        if left is not None:
            left = max(0, left - (end - base))
        if end:
            out[path] = [end, [zlib.crc32(head[:n]) for n in MARKS if n <= min(end, len(head))]]
    return out


class FileRange(InputPartition):
    """Lines of one file that begin in [start, end); ``first`` is the place where the unread part begins."""

    def __init__(self, path: str, first: int, start: int, end: int, stop: int, sums: list[int]):
        self.path, self.first, self.start, self.end, self.stop, self.sums = path, first, start, end, stop, sums


def ranges(start: dict[str, list], end: dict[str, list]) -> list[FileRange]:
    """What lies between two offsets; it follows from them alone, so a replayed batch reads the same bytes."""
    out = []
    for path, entry in sorted(end.items()):
        before = start.get(path)
        first = before[0] if before and same_file(before, entry) else 0
        for at in range(first, entry[0], RANGE_BYTES):
            out.append(FileRange(path, first, at, min(at + RANGE_BYTES, entry[0]), entry[0], entry[1]))
    return out


def read_range(part: FileRange, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the lines that begin in the range, fields matched by the file's own header.

    Short rows fill with null, empty fields are null, rows with more fields
    than the header are dropped, columns that a file lacks are null. A record
    is one line. Bytes of a generation that is gone by now give no rows.
    """
    filesystem, path = open_path(part.path)
    with filesystem.open_input_file(path) as stream:
        size = stream.size()
        head = stream.read_at(min(size, MARKS[-1]), 0)
        if size < part.stop or [zlib.crc32(head[:n]) for n in MARKS][: len(part.sums)] != part.sums:
            return
        header_end = _next_line_end(filesystem, path, 0, part.stop)
        head = stream.read_at(header_end, 0)
        names = next(csv.reader([head.decode("utf-8-sig", "replace").strip("\r\n")], skipinitialspace=True), [])
        places = {name.strip(): i for i, name in reversed(list(enumerate(names)))}
        take = [places.get(c, -1) for c in columns]
        at = max(part.start, header_end)
        if part.start > max(part.first, header_end):
            at = _next_line_end(filesystem, path, part.start - 1, part.stop)  # the line under way belongs to the range before
        finish = part.end if part.end == part.stop else _next_line_end(filesystem, path, part.end - 1, part.stop)
        kept: list[list[str | None]] = []
        rest = b""
        while at < finish:
            block = rest + stream.read_at(min(BLOCK * 16, finish - at), at)
            at += len(block) - len(rest)
            lines, _, rest = block.rpartition(b"\n")
            for record in csv.reader(x for x in lines.decode("utf-8", "replace").split("\n") if x.strip("\r")):
                if len(record) <= len(names):
                    kept.append([(record[i].rstrip("\r") or None) if 0 <= i < len(record) else None for i in take])
            if len(kept) >= ROWS:
                yield _batch(kept, columns, path)
                kept = []
        if kept:
            yield _batch(kept, columns, path)


def _batch(rows: list[list[str | None]], columns: list[str], path: str) -> pa.RecordBatch:
    fields = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns))]
    return pa.RecordBatch.from_arrays([*fields, pa.array([path.rpartition("/")[2]] * len(rows), pa.string())], [*columns, "source_file"])


class GrowingCsvReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], budget: int | None):
        self.path, self.columns, self.budget = path, columns, budget
        # Spark does not tell a Python source where a restarted query stands;
        # until the first batch is known, all whole lines are offered.
        self.last: dict[str, list] | None = None

    def initialOffset(self) -> dict:
        self.last = {}
        return {"files": {}}

    def latestOffset(self) -> dict:
        filesystem, inner = open_path(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        files = [
            (f.path, f.size) for f in found
            if f.type == fs.FileType.File and f.path.endswith(".csv") and not f.base_name.startswith((".", "_"))
        ]
        known = None if self.last is None else {p.removeprefix(prefix): e for p, e in self.last.items()}
        now = {prefix + p: e for p, e in advance(filesystem, files, known, self.budget).items()}
        self.last = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.last is None:
            self.last = end["files"]
        return ranges(start["files"], end["files"])

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class GrowingCsv(DataSource):
    """Options: path, columns (JSON list), maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in [*json.loads(self.options["columns"]), "source_file"])

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        budget = int(self.options.get("maxBytesPerTrigger", "0")) or None
        return GrowingCsvReader(self.options["path"], json.loads(self.options["columns"]), budget)


def read_growing_csv(spark: SparkSession, path: str, columns: list[str], max_bytes: int | None = None) -> DataFrame:
    """STR1: rows appended to the CSV files below ``path``, text columns and ``source_file``.

    The offset in the checkpoint has one entry per file, as the folder's
    listing has. ``max_bytes`` bounds a trigger; the first trigger after a
    restart takes what has come up to then. A writer's unfinished last line
    waits. Lines that went with a rotation before they were read are lost.
    """
    spark.dataSource.register(GrowingCsv)
    reader = spark.readStream.format(FORMAT).option("path", path).option("columns", json.dumps(columns))
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    return reader.load()
