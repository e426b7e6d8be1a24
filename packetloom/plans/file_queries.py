"""Sources and sinks over files that Spark first derives from the tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from packetloom import schemas
from packetloom.functions.labels import file_stem, label_from_filename
from packetloom.operators import evaluate, events as log, prep
from packetloom.operators.models import train_pipeline
from packetloom.plans.event_queries import D
from packetloom.plans.eval_queries import C, FILE_SCORES
from packetloom.plans.flow_queries import ALL, flow_cte, shown, shown_sql
from packetloom.plans.registry import query, rounded
from packetloom.plans.prep_queries import SHOWN
from packetloom.plans.stream_queries import MODEL_FEATURES, SMALL, _drain, _scratch, _stream, trained
from packetloom.plans.training import evaluate_folder, train_from_captures
from packetloom.sources import files, pcap, sinks
from packetloom.sources.adapters import adapter, oracle_cte, table
from packetloom.streaming import streams

LOG_SCHEMA = schemas.DETECTIONS


def _events(spark, sf_dir):
    return log.to_events(adapter(spark, sf_dir, "detections")).withColumn("prediction", F.col("is_attack").cast("int"))


@query(
    "csv_folder",
    "SELECT l_orderkey::VARCHAR AS key, l_returnflag AS label, l_suppkey::VARCHAR AS supplier, NULL AS total FROM lineitem "
    "UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus, NULL, floor(o_totalprice)::BIGINT::VARCHAR FROM orders",
)
def csv_folder(spark, sf_dir):
    """SRC1, SRC2, SRC8, SET1, SNK3: a CSV folder with two headers, written and read back."""
    root = _scratch(spark)
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ` key`", "l_suppkey AS supplier", "l_returnflag AS `label `")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS label", "cast(floor(o_totalprice) AS BIGINT) AS total")
    sinks.write_predictions(items, f"{root}/csv/items", "csv")
    sinks.write_predictions(orders, f"{root}/csv/orders", "csv")
    return files.read_flow_csv(spark, f"{root}/csv").select("key", "label", "supplier", "total")


def _write_frames(root: str, by_capture: bool = False):
    """Writes packet rows as capture files: one per task, or one per capture (rows sorted by capture)."""
    def head() -> bytes:
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, inner = fs.FileSystem.from_uri(root)
        filesystem.create_dir(inner, recursive=True)
        part = f"part{TaskContext.get().partitionId()}"
        ip = lambda text: bytes(int(x) for x in text.split("."))
        n, out, current = 0, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                name = r.capture_id if by_capture else part
                if name != current:
                    if out is not None:
                        out.close()
                    out, current = filesystem.open_output_stream(f"{inner}/{name}.pcap"), name
                    out.write(head())
                ports = struct.pack(">HH", r.src_port, r.dst_port)
                if r.proto == 6:
                    top = ports + struct.pack(">IIHHHH", 0, 0, 5 << 12 | r.tcp_flags, int(r.tcp_win), 0, 0)
                else:
                    top = ports + struct.pack(">HH", r.pkt_len, 0)
                body = top + bytes(r.pkt_len - len(top))
                net = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, r.proto, 0)
                frame = bytes(12) + b"\x08\x00" + net + ip(r.src_ip) + ip(r.dst_ip) + body
                out.write(struct.pack("<IIII", r.us // 1_000_000, r.us % 1_000_000, len(frame), len(frame)) + frame)
                n += 1
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [n]})

    return write


def _captures(spark, sf_dir, root):
    """The packet table as capture files, one per time range, written by tasks."""
    packets = adapter(spark, sf_dir, "packets").withColumn("us", F.unix_micros("ts"))
    ordered = packets.repartitionByRange(4, "us", "pkt_no").sortWithinPartitions("us", "pkt_no")
    ordered.mapInPandas(_write_frames(f"{root}/captures"), "n bigint").agg(F.sum("n")).first()
    return f"{root}/captures"


PACKET_COLS = "src_ip, src_port, dst_ip, dst_port, proto, hdr_len, pkt_len, tcp_flags"


@query(
    "pcap_packets",
    f"{oracle_cte('packets')} SELECT 'part' AS capture, epoch_us(ts) AS us, {PACKET_COLS}, tcp_win FROM packets",
)
def pcap_packets(spark, sf_dir):
    """SRC5: capture files to packet rows; ranges smaller than the files."""
    path = _captures(spark, sf_dir, _scratch(spark))
    df = pcap.read_pcap(spark, path, chunk=256 * 1024)
    named = F.regexp_replace("capture_name", "[0-9]+$", "").alias("capture")
    return df.select(named, F.unix_micros("ts").alias("us"), *PACKET_COLS.split(", "), "tcp_win")


def _named_captures(spark, sf_dir, root):
    """One capture file per capture of the table, named by its id."""
    packets = adapter(spark, sf_dir, "packets").withColumn("us", F.unix_micros("ts"))
    frames = packets.repartition("capture_id").sortWithinPartitions("capture_id", "us", "pkt_no")
    frames.mapInPandas(_write_frames(f"{root}/captures", by_capture=True), "n bigint").agg(F.sum("n")).first()
    return f"{root}/captures"


@query(
    "train_captures",
    f"{flow_cte()} SELECT 3 AS classes, ceil(count(*) * 0.2)::BIGINT AS test_rows, TRUE AS metrics_bounded FROM flows",
)
def train_captures(spark, sf_dir):
    """SRC5, JON1, ML18: captures and a label manifest to a fitted ensemble."""
    path = _named_captures(spark, sf_dir, _scratch(spark))
    manifest = spark.createDataFrame([("cap1.pcap", "SYN"), ("cap2", "UDP")], "file string, label string")
    features = ["flow_duration", "flow_iat_mean", "packet_length_mean", "syn_flag_count", "destination_port"]
    return trained(spark, train_from_captures(spark, path, manifest, features, models="rf", params=SMALL))


@query(
    "evaluate_csv_folder",
    f"{oracle_cte('cic_rows')} SELECT label AS y_true, count(*) AS n FROM cic_rows GROUP BY 1",
)
def evaluate_csv_folder(spark, sf_dir):
    """SRC1, SRC8, ML16, AGG3, SNK4: a CSV folder scored and evaluated in one plan."""
    root = _scratch(spark)
    rows = adapter(spark, sf_dir, "cic_rows")
    model = train_pipeline(rows, "label", SHOWN[:-1], MODEL_FEATURES, models="rf", params=SMALL)
    sinks.write_predictions(rows.withColumnRenamed("label", " Label "), f"{root}/csv", "csv")
    counts = evaluate_folder(spark, f"{root}/csv", model, out=f"{root}/metrics")
    return counts.groupBy("y_true").agg(F.sum("n").alias("n"))


# hdr_len of a written TCP frame is always 20 and of UDP 8, as in the table.
STREAMED = ALL


@query("stream_capture_flows", f"{flow_cte()} SELECT {', '.join(shown_sql(c) for c in STREAMED)} FROM flows")
def stream_capture_flows(spark, sf_dir):
    """STR2: a drop folder of captures as a stream of flow records, every column, split by capture.

    Each capture of the table becomes one file whose name carries its id.
    """
    root = _scratch(spark)
    found = streams.capture_stream(spark, _named_captures(spark, sf_dir, root))
    streams.start_capture_flows(found, f"{root}/flows", f"{root}/state", available_now=True).awaitTermination()
    flows = spark.read.parquet(f"{root}/flows").withColumn("capture_id", file_stem(F.col("capture_id")))
    return shown(flows, STREAMED)


@query(
    "stream_csv",
    "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS label FROM orders",
)
def stream_csv(spark, sf_dir):
    """STR1: a CSV drop folder as a stream, one file per trigger."""
    root = _scratch(spark)
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS label").repartition(3, "key")
    sinks.write_predictions(rows, f"{root}/csv", "csv")
    stream = streams.read_csv_stream(spark, f"{root}/csv", ["key", "label"], max_files=1)
    return _drain(spark, stream, root).select("key", "label")


@query(
    "event_log",
    f"{D} SELECT event_uid, us, prediction_label, round(confidence, 6) AS confidence, is_attack, severity, source FROM e",
)
def event_log(spark, sf_dir):
    """SNK1: events appended as JSON lines, read back."""
    root = _scratch(spark)
    sinks.write_events(_events(spark, sf_dir), f"{root}/log")
    back = sinks.read_events(spark, f"{root}/log", LOG_SCHEMA)
    return rounded(back.select("event_uid", F.unix_micros("ts").alias("us"), "prediction_label", "confidence", "is_attack", "severity", "source"))


@query(
    "event_archive",
    f"{D} SELECT event_uid, us, prediction_label, severity, source, "
    "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'archive' ELSE 'log' END AS place FROM e",
)
def event_archive(spark, sf_dir):
    """SNK5: whole days moved to the archive; a second call changes nothing."""
    root = _scratch(spark)
    sinks.write_events(_events(spark, sf_dir), f"{root}/log")
    for _ in range(2):
        sinks.archive_events(spark, f"{root}/log", f"{root}/old", "2024-01-11", "run", LOG_SCHEMA)
    kept = sinks.read_events(spark, f"{root}/log", LOG_SCHEMA).withColumn("place", F.lit("log"))
    moved = sinks.read_events(spark, f"{root}/old/archive=run", LOG_SCHEMA).withColumn("place", F.lit("archive"))
    both = kept.unionByName(moved, allowMissingColumns=True)
    return both.select("event_uid", F.unix_micros("ts").alias("us"), "prediction_label", "severity", "source", "place")


@query(
    "timeline_file",
    f"{D} SELECT iso AS timestamp, prediction_label, printf('%.6f', confidence) AS confidence, (is_attack::INT)::VARCHAR AS is_attack, severity, source FROM e",
)
def timeline_file(spark, sf_dir):
    """SNK2: the timeline CSV."""
    root = _scratch(spark)
    sinks.write_timeline(_events(spark, sf_dir), f"{root}/timeline")
    return spark.read.option("header", True).csv(f"{root}/timeline")


@query(
    "evaluation_files",
    f"{C}{FILE_SCORES}, a AS (SELECT source_file, count(*) AS n, round(avg((t = p)::INT), 6)::DOUBLE AS accuracy FROM s GROUP BY ALL) "
    "SELECT 'per_file' AS output, source_file AS row_name, 'rows' AS name, n::DOUBLE AS value FROM a "
    "UNION ALL SELECT 'per_file', source_file, 'accuracy', accuracy FROM a "
    "UNION ALL SELECT 'per_file', source_file, 'f1_weighted', f1_weighted FROM fm "
    "UNION ALL SELECT 'per_file', source_file, 'precision_weighted', precision_weighted FROM fm "
    "UNION ALL SELECT 'confusion', x.label, y.label, coalesce(n, 0)::DOUBLE FROM labels x JOIN labels y ON true LEFT JOIN pairs ON t = x.label AND p = y.label "
    "UNION ALL SELECT 'shares', x.label, y.label, CASE WHEN x.support = 0 THEN 0 ELSE round(coalesce(n, 0) / x.support, 6) END::DOUBLE "
    "FROM cls x JOIN labels y ON true LEFT JOIN pairs ON t = x.label AND p = y.label "
    "UNION ALL SELECT 'overall', NULL, 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6) FROM m",
)
def evaluation_files(spark, sf_dir):
    """SNK4: the values of every evaluation file, read back."""
    root = _scratch(spark)
    sinks.write_evaluation(evaluate.scored_counts(adapter(spark, sf_dir, "scored")), f"{root}/eval")

    def values(folder, output, row_name, names=None):
        frame = spark.read.option("header", True).csv(f"{root}/eval/{folder}")
        names = names or [c for c in frame.columns if c != row_name]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(f"`{c}`").cast("double"), 6).alias("value")) for c in names])
        key = F.col(row_name) if row_name else F.lit(None).cast("string")
        return frame.select(F.lit(output).alias("output"), key.alias("row_name"), F.inline(cells))

    parts = [
        values("per_file_metrics", "per_file", "source_file", ["rows", "accuracy", "f1_weighted", "precision_weighted"]),
        values("confusion_matrix", "confusion", "y_true"),
        values("confusion_matrix_normalized", "shares", "y_true"),
        values("overall_metrics", "overall", None, ["accuracy"]),
    ]
    return prep.union_files(parts)


@query(
    "feature_files",
    f"{oracle_cte('cic_rows')}, x AS (SELECT 'udp_' || source_file AS f, label FROM cic_rows WHERE protocol = 17 UNION ALL SELECT source_file, label FROM cic_rows WHERE protocol = 6) "
    "SELECT CASE WHEN f LIKE 'udp%' THEN 'udp_flood' ELSE 'normal' END AS label, CASE WHEN f LIKE 'udp%' THEN 1 ELSE 0 END AS code, count(*) AS n FROM x GROUP BY ALL",
)
def feature_files(spark, sf_dir):
    """SNK6: features and label table as files."""
    root = _scratch(spark)
    rows = adapter(spark, sf_dir, "cic_rows").selectExpr("row_id", "concat(if(protocol = 17, 'udp_', ''), source_file) AS f")
    coded, mapping = prep.encode_labels(rows.withColumn("label", label_from_filename(F.col("f"))), "label", "y")
    sinks.write_features(coded, mapping, root)
    back = spark.read.parquet(f"{root}/features").groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    names = spark.read.schema("label string, code bigint").json(f"{root}/label_mapping")
    return names.join(back, names["code"] == back["y"]).select("label", "code", "n")


@query(
    "stream_scoring",
    """WITH x AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN value > 100 THEN 'SYN_FLOOD' ELSE 'normal' END AS prediction_label, value / 500 AS confidence FROM events)
SELECT substr(md5(event_id || '|stream'), 1, 16) AS event_uid, us, prediction_label, round(confidence, 6) AS confidence, prediction_label <> 'normal' AS is_attack,
  CASE WHEN prediction_label = 'normal' THEN 'info' WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM x""",
)
def stream_scoring(spark, sf_dir):
    """STR5, TXT6: micro-batches scored and logged under repeatable ids."""
    root = _scratch(spark)

    def score(batch):
        return batch.selectExpr(
            "cast(ts AS TIMESTAMP) AS ts", "event_id", "if(value > 100, 'SYN_FLOOD', 'normal') AS prediction_label",
            "value / 500 AS confidence", "'stream' AS source",
        )

    rows = _stream(spark, sf_dir, "events")
    streams.start_scoring(rows, score, f"{root}/log", f"{root}/state", ["event_id", "source"], True).awaitTermination()
    back = spark.read.schema(LOG_SCHEMA).json(f"{root}/log")
    return rounded(back.select("event_uid", F.unix_micros("ts").alias("us"), "prediction_label", "confidence", "is_attack", "severity"))
