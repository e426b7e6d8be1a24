"""Windowed rate features from flow rows (batch or stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.labels import label_from_filename
from packetloom.operators.prep import encode_labels

ROLES = {
    "ts": "flow_ts",
    "src_port": "src_port",
    "dst_port": "dst_port",
    "protocol": "protocol",
    "syn": "syn_flag_count",
    "length": "packet_length_mean",
}


def standard_aggregates(window_seconds: int, roles: dict[str, str] | None = None) -> list[Column]:
    """The six rates. UDP and NTP count per minute, the others per second."""
    r = {**ROLES, **(roles or {})}
    w = float(window_seconds)
    port = lambda p: f"({r['src_port']} = {p} OR {r['dst_port']} = {p})"
    texts = [
        f"count(1) / {w}D AS pkt_rate",
        f"coalesce(sum({r['syn']}), 0) / {w}D AS syn_rate",
        f"count_if({r['protocol']} = 17) * 60 / {w}D AS udp_rate",
        f"count_if({port(53)}) / {w}D AS dns_rate",
        f"count_if({port(123)}) * 60 / {w}D AS ntp_rate",
        f"coalesce(avg({r['length']}), 0D) AS avg_pkt_size",
    ]
    return [F.expr(t) for t in texts]


def numeric_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """FEA2: every numeric column that is no identifier and no label."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def extract_features(
    df: DataFrame,
    mode: str = "standard",
    window_seconds: int = 1,
    by: list[str] | None = None,
    exclude: list[str] | None = None,
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """FEA1-3: per-window rates, all numeric columns, or both.

    ``hybrid`` adds the window mean of every numeric column; both sets come
    out of one aggregate over the same groups. ``by`` adds grouping columns
    such as the source file.
    """
    r = {**ROLES, **(roles or {})}
    exclude = list(exclude or [])
    by = list(by or [])
    if mode == "full":
        return df.select(*by, *numeric_columns(df, exclude + by))
    if mode not in ("standard", "hybrid"):
        raise ValueError(f"unknown feature mode: {mode}")
    aggs = standard_aggregates(window_seconds, roles)
    if mode == "hybrid":
        aggs += [F.avg(c).alias(f"{c}_mean") for c in numeric_columns(df, exclude + by)]
    bucket = F.window(F.col(r["ts"]), f"{window_seconds} seconds")
    grouped = df.groupBy(*by, bucket.alias("w")).agg(*aggs)
    kept = [c for c in grouped.columns if c not in ("w", *by)]
    return grouped.select(
        *by, F.col("w.start").alias("window_start"), F.lit(window_seconds).alias("window_seconds"), *kept
    )


def labelled_features(
    df: DataFrame, file_col: str = "source_file", window_seconds: int = 1, roles: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """FEA5: features per file, the label its name hints at, and dense codes."""
    feats = extract_features(df, "standard", window_seconds, by=[file_col], roles=roles)
    feats = feats.withColumn("label", label_from_filename(F.col(file_col)))
    return encode_labels(feats, "label", "y")
