"""Composed plans around the ensemble: captures to a model, CSV folders to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import evaluate, prep
from packetloom.operators.enrich import manifest_labels
from packetloom.operators.flows import build_flows
from packetloom.operators.models import Ensemble, train_pipeline
from packetloom.sources import sinks
from packetloom.sources.files import read_flow_csv
from packetloom.sources.pcap import read_pcap

FLOW_KEYS = ["capture_id", "flow_id", "protocol"]
# Columns of a flow record that name it or are constant by definition.
NO_FEATURE = {
    "capture_id", "flow_id", "source_ip", "source_port", "destination_ip", "timestamp", "label", "simillar_http",
    "fwd_avg_bytes_bulk", "fwd_avg_packets_bulk", "fwd_avg_bulk_rate", "bwd_avg_bytes_bulk", "bwd_avg_packets_bulk",
    "bwd_avg_bulk_rate", "active_std", "idle_mean", "idle_std", "idle_max", "idle_min",
}


def labelled_flows(spark: SparkSession, path: str, manifest: DataFrame, default: str = "BENIGN") -> DataFrame:
    """Flow records of a capture folder with the label of their capture (SRC5, FLW0-16, JON1)."""
    return manifest_labels(build_flows(read_pcap(spark, path)).drop("label"), "capture_id", manifest, default)


def train_from_captures(
    spark: SparkSession, path: str, manifest: DataFrame, features: list[str] | None = None, **options
) -> Ensemble:
    """Captures to a fitted ensemble (ML18); ``features`` default to every measuring column."""
    flows = labelled_flows(spark, path, manifest)
    return train_pipeline(flows, "label", FLOW_KEYS, features or [c for c in flows.columns if c not in NO_FEATURE], **options)


def evaluate_folder(
    spark: SparkSession, path: str, ensemble: Ensemble, label: str | None = None, out: str | None = None
) -> DataFrame:
    """Label pairs per file of a CSV folder scored by an ensemble; with ``out`` the metric files as well (AGG3-11, SNK4).

    The label column is found by name unless given. Rows are read and scored once.
    """
    rows = read_flow_csv(spark, path)
    column = prep.resolve_label_column(rows.columns, label)
    scored = ensemble.score(rows.withColumn("__true", F.col(f"`{column}`")))
    counts = evaluate.scored_counts(scored, true="__true", pred="prediction_label")
    if out is not None:
        # A few rows per file: pinned, so that the outputs do not score again.
        counts = prep.pinned(counts)
        sinks.write_evaluation(counts, out)
    return counts
