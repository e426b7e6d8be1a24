"""Composed batch plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.explain import explain
from packetloom.operators.features import extract_features
from packetloom.operators.flows import flow_totals
from packetloom.operators.fusion import fuse, model_side
from packetloom.operators.rules import apply_rules, rule_only_verdict

FLOW_ROLES = {
    "ts": "timestamp",
    "src_port": "source_port",
    "dst_port": "destination_port",
    "protocol": "protocol",
    "syn": "syn_flag_count",
    "length": "packet_length_mean",
}


def window_verdicts(packets: DataFrame, window_seconds: int = 1, config: dict | None = None) -> DataFrame:
    """Packets to an attack verdict per time window, rules only.

    The window features need no packet order, so the flow step is one
    map-side-combined aggregate and the windows a second small one.
    """
    features = extract_features(flow_totals(packets), "standard", window_seconds, roles=FLOW_ROLES)
    return rule_only_verdict(apply_rules(features, config))


def fused_detections(rates: DataFrame, mode: str = "weighted", config: dict | None = None) -> DataFrame:
    """Rule and model verdicts fused and explained for rate rows."""
    judged = fuse(model_side(apply_rules(rates, config)), mode)
    return explain(judged, strategy=F.col("fusion_strategy"))
