from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.operators.fusion import fuse, model_side
from packetloom.operators.rules import apply_rules

LIMITS = [
    ("syn_rate", "syn_flood_per_sec", "SYN_FLOOD"), ("udp_rate", "udp_flood_per_min", "UDP_FLOOD"),
    ("dns_rate", "dns_flood_per_sec", "DNS_FLOOD"), ("ntp_rate", "ntp_flood_per_min", "NTP_FLOOD"),
]
NAMES = ["pkt_rate", "syn_rate", "udp_rate", "dns_rate", "ntp_rate", "avg_pkt_size"]


def verdict(spark, values, config=None):
    df = spark.createDataFrame([values], ", ".join(f"{n} double" for n in NAMES))
    return apply_rules(df, config).first()


def around(limit: float) -> list[float]:
    """Far below, just below, at, just above, far above a threshold."""
    return [0.0, limit * (1 - 1e-9), limit, limit * (1 + 1e-9), limit * 7]


@pytest.mark.parametrize("column, setting, kind", LIMITS)
def test_each_rule_fires_from_its_threshold_on(spark, column, setting, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(around(K.RULE_THRESHOLDS[setting]))], f"i int, {column} double")
    rows = apply_rules(df).orderBy("i").collect()
    assert [r["rule_is_attack"] for r in rows] == [False, False, True, True, True]
    assert [r["rule_attack_type"] for r in rows] == ["NORMAL"] * 2 + [kind] * 3


@pytest.mark.parametrize("column, setting, kind", LIMITS)
def test_a_threshold_of_ones_own(spark, column, setting, kind):
    own = K.RULE_THRESHOLDS[setting] / 16
    df = spark.createDataFrame([(i, v) for i, v in enumerate(around(own))], f"i int, {column} double")
    assert not any(r["rule_is_attack"] for r in apply_rules(df.where(f"{column} < {own * 2}")).collect())
    rows = apply_rules(df, {"rule_thresholds": {setting: own}}).orderBy("i").collect()
    assert [r["rule_is_attack"] for r in rows] == [False, False, True, True, True]


def test_quiet_windows_are_normal(spark):
    row = verdict(spark, [1.0] * len(NAMES))
    assert row["rule_attack_type"] == "NORMAL" and row["triggers"] == []


def test_payload_keywords(spark):
    texts = ["weather in Lyon", "x' union select card from wallet; drop view v --", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    assert [r["rule_is_attack"] for r in apply_rules(df).orderBy("i").collect()] == [False, True, False, False]


def test_unusable_rates_do_not_fire(spark):
    df = spark.createDataFrame([(float("nan"), "abc"), (None, "")], "syn_rate double, udp_rate string")
    assert not any(r["rule_is_attack"] for r in apply_rules(df).collect())


def test_first_critical_wins(spark):
    row = verdict(spark, (0.0, 600.0, 25000.0, 4500.0, 1.0, 500.0))
    assert row["rule_attack_type"] == "UDP_FLOOD"
    assert row["rule_confidence"] == pytest.approx(1.0)


def test_missing_model_side_is_normal(spark):
    df = spark.createDataFrame([(600.0, None, None)], "syn_rate double, ml_label string, ml_confidence double")
    row = fuse(model_side(apply_rules(df)), "weighted").first()
    assert (row["model_attack_type"], row["model_confidence"]) == ("NORMAL", 0.0)
    # 0.4 x 0.65 stays below the threshold and only one side says attack
    assert row["fused_attack_type"] == "NORMAL"


def test_no_python_in_rule_plan(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("syn_rate"))
    plan = apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
