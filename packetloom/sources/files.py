"""Flow CSV folders and CSV message envelopes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import constants as K
from packetloom.functions.labels import file_name

CORRUPT = "__record"
BLANKS = " \t\n\x0b\f\r"
MAX_HEADERS = 1_000


def with_source_file(df: DataFrame, path: Column | None = None) -> DataFrame:
    """SRC4: name of the file a row came from."""
    name = F.col("_metadata.file_name") if path is None else file_name(path)
    return df.withColumn("source_file", name)


def _scan(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return (
        spark.read.format(fmt)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )


def _read_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        lines = []
        for path in batch["path"]:
            filesystem, inner = fs.FileSystem.from_uri(path)
            with filesystem.open_input_stream(inner) as stream:
                head = b""
                while b"\n" not in head:
                    block = stream.read(65536)
                    if not block:
                        break
                    head += block
            lines.append(head.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r"))
        yield pd.DataFrame({"path": batch["path"], "header": lines})


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, header line) of every CSV file below ``path``, read in tasks.

    Lock files start with a dot, which Spark's listing already leaves out.
    """
    files = _scan(spark, path, "binaryFile").load(path).select("path")
    return files.mapInPandas(_read_header, "path string, header string")


def _read_group(spark: SparkSession, paths: list[str], columns: list[str], multi_line: bool) -> DataFrame:
    """All columns as text. Short rows fill with null; rows with more fields
    than the header, even empty ones, are malformed and dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multi_line)
    # Records of another width come with their text; pruned columns would hide the width.
    raw = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(paths)
    unquoted = F.regexp_replace(CORRUPT, '"[^"]*"', "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    # A column of the file's own under this name gives way.
    fields = [F.col(f"`{c}`") for c in columns if c != "source_file"]
    kept = raw.where(F.col(CORRUPT).isNull() | (commas < len(columns)))
    return kept.select(*fields, F.col("_metadata.file_name").alias("source_file"))


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name.strip() or f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if k == 0 else f"{name}.{k}")
    return out


def _header_names(header: str) -> list[str]:
    """Column names of a header line, quoted ones included."""
    return _unique(next(csv.reader([header], skipinitialspace=True), []))


def read_flow_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC1, SRC2, SET1: every CSV below a folder as one table of text columns.

    Files are grouped by header line; each group is one scan and differing
    columns union by name. Only the header table (one row per file) reaches
    the driver, as any file listing does. ``multi_line`` keeps records with
    line breaks inside quotes whole; each file is then one task's work.
    """
    rows = csv_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups = rows.orderBy("header").limit(MAX_HEADERS + 1).collect()
    if not groups:
        raise FileNotFoundError(f"no CSV files below {path}")
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different CSV headers below {path}")
    out = None
    for group in groups:
        frame = _read_group(spark, list(group["paths"]), _header_names(group["header"]), multi_line)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


PROGRESS = "path string, consumed bigint"


def grown_files(spark: SparkSession, path: str, progress: DataFrame) -> DataFrame:
    """STR1: (path, start, size) of CSV files with bytes beyond what ``progress`` (path, consumed) says.

    Spark's file streams never look at a known file again; this listing finds
    the ones that were appended to since, and new ones (start 0).
    """
    found = _scan(spark, path, "binaryFile").load(path).select("path", F.col("length").alias("size"))
    known = progress.groupBy("path").agg(F.max("consumed").alias("start"))
    joined = found.join(known, "path", "left").withColumn("start", F.coalesce("start", F.lit(0)).cast("bigint"))
    return joined.where(F.col("size") > F.col("start")).select("path", "start", "size")


def read_appended(grown: DataFrame, columns: list[str], max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """STR1: (rows, progress) of the appended parts of files (path, start, size).

    Whole lines only: what a writer has not finished waits for the next call,
    and so does what exceeds ``max_bytes`` of a file, so a cycle stays bounded.
    A file's first line is its header; rows with too many fields are dropped.
    Both results derive from the same listing; store ``progress`` after the rows.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                filesystem, inner = fs.FileSystem.from_uri(row["path"])
                with filesystem.open_input_file(inner) as stream:
                    want = min(row["size"] - row["start"], max_bytes)
                    data = stream.read_at(want, row["start"])
                    # A line longer than the bound is read to its end.
                    while b"\n" not in data and row["start"] + len(data) < row["size"]:
                        data += stream.read_at(min(max_bytes, row["size"] - row["start"] - len(data)), row["start"] + len(data))
                yield row["path"], row["start"], data[: data.rfind(b"\n") + 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for path, start, data in parts(batches):
            text = io.StringIO(data.decode("utf-8-sig" if start == 0 else "utf-8", "replace"), newline="")
            records = [r for r in csv.reader(text) if r and len(r) <= len(columns)][1 if start == 0 else 0 :]
            fields = [pa.array([(r[k] or None) if k < len(r) else None for r in records], pa.string()) for k in range(len(columns))]
            name = pa.array([path.rpartition("/")[2]] * len(records), pa.string())
            yield pa.RecordBatch.from_arrays([*fields, name], [*columns, "source_file"])

    def progress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, data in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start + len(data)], pa.int64())], ["path", "consumed"])

    spread = max(grown.sparkSession.sparkContext.defaultParallelism, 1)
    work = grown.select("path", "start", "size").repartition(spread * 4, "path")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "source_file"]])
    return work.mapInArrow(rows, schema), work.mapInArrow(progress, PROGRESS)


def decode_csv_messages(df: DataFrame, body: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """SRC6: rows of CSV text wrapped in messages; works on batch and stream.

    The first line names the file behind a fixed prefix, the second is the
    CSV header. Messages without prefix or content are dropped, and so are
    blank lines and records with too many fields. A message is parsed as one
    document, so quoted line breaks stay inside their record; ``line_no``
    counts records from the header, which is 0.
    """
    keep = list(keep or [])
    names = [*keep, "file_path", "line_no", *columns]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            at, paths, numbers, rows = [], [], [], []
            for i, text in enumerate(batch.column("__body").to_pylist()):
                head, line_break, rest = (text or "").strip(BLANKS).partition("\n")
                head = head.strip(" ")
                if not line_break or not head.startswith(K.CSV_ENVELOPE_PREFIX):
                    continue
                for number, record in enumerate(csv.reader(io.StringIO(rest, newline=""))):
                    blank = not record or (len(record) == 1 and not record[0].strip(" "))
                    if number == 0 or blank or len(record) > len(columns):
                        continue
                    at.append(i)
                    paths.append(head[len(K.CSV_ENVELOPE_PREFIX) :].strip(" "))
                    numbers.append(number)
                    rows.append([*(field or None for field in record), *[None] * (len(columns) - len(record))])
            taken = pa.array(at, pa.int64())
            fields = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(taken) for c in keep), pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), *fields],
                names,
            )

    work = df.select(*keep, F.col(body).cast("string").alias("__body"))
    fixed = [T.StructField("file_path", T.StringType()), T.StructField("line_no", T.IntegerType())]
    texts = [T.StructField(c, T.StringType()) for c in columns]
    return work.mapInArrow(decode, T.StructType([*(work.schema[c] for c in keep), *fixed, *texts]))
