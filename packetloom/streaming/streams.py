"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from packetloom.operators import events as log
from packetloom.operators.features import extract_features
from packetloom.operators.flows import FLOW_KEY, build_flows, with_flow_key
from packetloom.operators.models import Ensemble, train_pipeline
from packetloom.operators.rules import apply_rules, rule_only_verdict
from packetloom.operators.sampling import online_window
from packetloom.sources.pcap import packets_of
from packetloom.sources.sinks import TIME_FORMAT

EXTRA = "__extra"


def read_csv_stream(
    spark: SparkSession,
    path: str,
    columns: list[str],
    max_files: int | None = None,
    since: str | None = None,
) -> DataFrame:
    """STR1: CSV drop folder as a stream of text columns.

    The checkpoint remembers the files already read. ``since`` skips files
    written before a moment. Writers must drop whole files.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, EXTRA]])
    reader = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
    reader = reader.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.csv(path).select(
        "*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_modification_time").alias("__mtime")
    )
    if since:
        rows = rows.where(F.col("__mtime") > F.to_timestamp(F.lit(since)))
    return rows.where(F.col(EXTRA).isNull()).drop(EXTRA, "__mtime")


def capture_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """STR2: new capture files (path, size); contents are read later in tasks."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    reader = reader.option("pathGlobFilter", "*.[pP][cC][aA][pP]").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("path", F.col("length").alias("size"))


def start_capture_flows(
    captures: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """STR2: every new capture becomes flow records, one folder per batch.

    A batch replayed after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        build_flows(packets_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(captures.writeStream.foreachBatch(write), checkpoint, available_now)


def window_verdict_stream(
    rows: DataFrame, ts: str, window_seconds: int, delay: str, config: dict | None = None, roles: dict | None = None
) -> DataFrame:
    """STR3: tumbling-window rates with rule verdicts, late rows dropped after ``delay``."""
    features = extract_features(rows.withWatermark(ts, delay), "standard", window_seconds, roles={**(roles or {}), "ts": ts})
    return rule_only_verdict(apply_rules(features, config))


SESSION_SUMS = {
    "total_fwd_packets": "int(is_fwd)",
    "total_backward_packets": "int(NOT is_fwd)",
    "total_length_of_fwd_packets": "if(is_fwd, pkt_len, 0)",
    "total_length_of_bwd_packets": "if(is_fwd, 0, pkt_len)",
    "syn_flag_count": "int(proto = 6 AND (tcp_flags & 2) != 0)",
    "ack_flag_count": "int(proto = 6 AND (tcp_flags & 16) != 0)",
    "len_sq": "cast(pkt_len AS BIGINT) * pkt_len",
}
SESSION_MINS = {
    "first_us": "ts_us", "fwd_first": "if(is_fwd, ts_us, NULL)", "bwd_first": "if(is_fwd, NULL, ts_us)",
    "min_packet_length": "pkt_len",
}
SESSION_MAXS = {
    "last_us": "ts_us", "fwd_last": "if(is_fwd, ts_us, NULL)", "bwd_last": "if(is_fwd, NULL, ts_us)",
    "max_packet_length": "pkt_len",
}


def _session_partials() -> list[Column]:
    parts = [f"sum(cast({e} AS DECIMAL(28,0))) AS {c}" for c, e in SESSION_SUMS.items()]
    parts += [f"min({e}) AS {c}" for c, e in SESSION_MINS.items()]
    parts += [f"max({e}) AS {c}" for c, e in SESSION_MAXS.items()]
    return [F.expr(p) for p in parts]


def _session_records(sums: DataFrame) -> DataFrame:
    """Output columns from the merged partials; the deviation is exact integer arithmetic."""
    n = "(total_fwd_packets + total_backward_packets)"
    total = "(total_length_of_fwd_packets + total_length_of_bwd_packets)"
    spread = (
        f"coalesce(double(try_cast({n} AS DECIMAL(12,0)) * try_cast(len_sq AS DECIMAL(26,0)) "
        f"- try_cast({total} AS DECIMAL(19,0)) * try_cast({total} AS DECIMAL(19,0))), "
        # Sums beyond the decimal range fall back to doubles.
        f"greatest(double({n}) * double(len_sq) - double({total}) * double({total}), 0D))"
    )
    counts = [c for c in SESSION_SUMS if c != "len_sq"]
    return sums.selectExpr(
        *FLOW_KEY, "first_us", "last_us", "last_us - first_us AS flow_duration",
        *[f"cast({c} AS BIGINT) AS {c}" for c in counts],
        "min_packet_length", "max_packet_length",
        f"double({total}) / double({n}) AS packet_length_mean",
        f"sqrt({spread}) / double({n}) AS packet_length_std",
        f"coalesce(try_divide(double(last_us - first_us), double({n} - 1)), 0D) AS flow_iat_mean",
        "coalesce(fwd_last - fwd_first, 0L) AS fwd_iat_total",
        "coalesce(bwd_last - bwd_first, 0L) AS bwd_iat_total",
    )


def flow_sessions(packets: DataFrame, idle_seconds: int) -> DataFrame:
    """STR4 on a table: flow records that close after an idle gap.

    Two packets in the same bucket of the idle length are less than the gap
    apart, so each (flow, bucket) lies in one session and aggregates map-side
    first, however many packets a flow holds. Only bucket rows are ordered,
    at most one per idle length of the flow's life.
    """
    idle = idle_seconds * 1_000_000
    keys = ", ".join(FLOW_KEY)
    keyed = with_flow_key(packets).withColumn("__b", F.expr(f"floor(ts_us / {idle}D)"))
    buckets = keyed.groupBy(*FLOW_KEY, "__b").agg(*_session_partials())
    opened = buckets.withColumn(
        "__opens",
        F.expr(f"int(coalesce(first_us - lag(last_us) OVER (PARTITION BY {keys} ORDER BY __b) >= {idle}, true))"),
    )
    numbered = opened.withColumn("__session", F.expr(f"sum(__opens) OVER (PARTITION BY {keys} ORDER BY __b)"))
    merged = numbered.groupBy(*FLOW_KEY, "__session").agg(
        *[F.expr(f"sum({c}) AS {c}") for c in SESSION_SUMS],
        *[F.expr(f"min({c}) AS {c}") for c in SESSION_MINS],
        *[F.expr(f"max({c}) AS {c}") for c in SESSION_MAXS],
    )
    return _session_records(merged)


def flow_session_stream(packets: DataFrame, idle_seconds: int, delay: str) -> DataFrame:
    """STR4 on a stream: the state is one row of partial aggregates per open
    flow; sessions merge inside each input task before the shuffle."""
    keyed = with_flow_key(packets.withWatermark("ts", delay))
    window = F.session_window("ts", f"{idle_seconds} seconds").alias("w")
    return _session_records(keyed.groupBy(*FLOW_KEY, window).agg(*_session_partials()))


def start_scoring(
    records: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    uid_keys: list[str],
    available_now: bool = False,
) -> StreamingQuery:
    """STR5: score each micro-batch and log its events.

    Ids derive from the record key and every batch owns one folder, so a
    replayed batch writes the same rows to the same place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log.to_events(score(batch), uid_keys).write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(f"{out}/batch={batch_id}")

    return _start(records.writeStream.foreachBatch(write), checkpoint, available_now)


def summary_stream(events: DataFrame) -> DataFrame:
    """STR6: running counts per label and source for complete or update mode.

    State grows with labels x sources only.
    """
    return events.groupBy("prediction_label", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("attacks"), F.max("ts").alias("last_ts")
    )


def event_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """STR7: stored events as an incremental feed; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)


def alert_stream(events: DataFrame, delay: str) -> DataFrame:
    """STR8: attack events, each id once within the watermark."""
    return log.attack_events(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_uid"])


def start_batch_alerts(events: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """STR8: alert roll-up per source for every micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log.batch_messages(log.batch_alerts(batch)).write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(f"{out}/batch={batch_id}")

    return _start(events.writeStream.foreachBatch(write), checkpoint, available_now)


def retrain(
    rows: DataFrame, file_col: str, label: str, keys: list[str], features: list[str], window_rows: int,
    max_rows_per_file: int | None = None, **options,
) -> Ensemble:
    """STR9: scheduled retraining from the current window of rows."""
    window = online_window(rows, file_col, keys, window_rows, max_rows_per_file)
    return train_pipeline(window, label, keys, features, **options)


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append-mode parquet sink with exactly-once commits."""
    return _start(df.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, available_now)
