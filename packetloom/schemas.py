"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("pkt_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("hdr_len", T.IntegerType()),
        T.StructField("pkt_len", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_win", T.IntegerType()),
    ]
)

GEO = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("country", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

DETECTIONS = T.StructType(
    [
        T.StructField("event_uid", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("prediction_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_attack", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("input_kind", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("pkt_len", T.DoubleType()),
        T.StructField("syn_count", T.DoubleType()),
        T.StructField("udp_count", T.DoubleType()),
    ]
)
