"""Fusing rule and model verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.labels import is_attack_label, normalize_attack_type
from packetloom.functions.numeric import parse_double
from packetloom.functions.text import format_value

MODES = ("weighted", "voting", "rule_only", "ml_only")


def model_side(
    df: DataFrame, label: str = "ml_label", confidence: str = "ml_confidence", required: list[str] | None = None
) -> DataFrame:
    """FUS4: normalised model verdict; NORMAL / 0 when any input is unusable."""
    usable = F.col(label).isNotNull() & F.col(confidence).isNotNull()
    for name in required or []:
        usable = usable & (parse_double(F.col(name)).isNotNull() if name in df.columns else F.lit(False))
    df = df.withColumn(
        "model_attack_type",
        F.when(usable, normalize_attack_type(F.col(label).cast("string"))).otherwise(F.lit("NORMAL")),
    )
    return df.withColumns(
        {
            "model_is_attack": is_attack_label(F.col("model_attack_type")),
            "model_confidence": F.when(usable, F.col(confidence).cast("double")).otherwise(F.lit(0.0)),
        }
    )


def _explanation(verdict: Column, confidence: Column, strategy: str) -> Column:
    two = lambda c: format_value(c, ".2f")
    rule_type = normalize_attack_type(F.col("rule_attack_type"))
    rule_line = F.when(
        F.col("rule_is_attack"),
        F.concat(
            F.lit("Rule engine: "), rule_type, F.lit(" (confidence="), two(F.col("rule_confidence")), F.lit(")\n"),
            F.col("rule_explanation"),
        ),
    ).otherwise(F.lit("Rule engine: NORMAL"))
    model_line = F.concat(
        F.lit("ML detector: "), F.col("model_attack_type"), F.lit(" (confidence="),
        two(F.col("model_confidence")), F.lit(")"),
    )
    final = F.concat(
        F.lit("Fusion verdict: "), F.when(verdict, F.lit("ATTACK")).otherwise(F.lit("NORMAL")),
        F.lit(" (confidence="), two(confidence), F.lit(f", strategy={strategy})"),
    )
    return F.concat_ws("\n", rule_line, model_line, final)


def fuse(
    df: DataFrame,
    mode: str = "weighted",
    rule_weight: float = K.RULE_WEIGHT,
    model_weight: float = K.MODEL_WEIGHT,
    threshold: float = K.FUSION_THRESHOLD,
) -> DataFrame:
    """FUS1-3, FUS5: final verdict from rule_* and model_* columns."""
    if mode not in MODES:
        raise ValueError(f"unknown fusion mode: {mode}")
    rule, model = F.col("rule_is_attack"), F.col("model_is_attack")
    rule_conf, model_conf = F.col("rule_confidence"), F.col("model_confidence")
    rule_type = normalize_attack_type(F.col("rule_attack_type"))
    model_type = F.col("model_attack_type")
    attack_type = F.when(rule, rule_type).when(model, model_type).otherwise(F.lit("NORMAL"))
    strategy = mode

    if mode == "weighted":
        total = max(rule_weight + model_weight, 1e-6)
        score = lambda on, c: F.when(on, c).otherwise(F.lit(0.0))
        confidence = (F.lit(rule_weight) * score(rule, rule_conf) + F.lit(model_weight) * score(model, model_conf)) / (
            F.lit(total)
        )
        quiet = (confidence < threshold) & ~(rule & model)
        fused_type = F.when(quiet, F.lit("NORMAL")).otherwise(attack_type)
        verdict = fused_type != "NORMAL"
    elif mode == "voting":
        verdict = rule | model
        fused_type = attack_type
        confidence = F.when(verdict, F.greatest(rule_conf, model_conf)).otherwise((rule_conf + model_conf) / 2)
    elif mode == "rule_only":
        verdict, fused_type, confidence = rule, rule_type, rule_conf
    else:
        verdict, fused_type, confidence = model, model_type, model_conf

    out = df.withColumns(
        {"fused_attack_type": fused_type, "fused_is_attack": verdict, "fused_confidence": confidence}
    )
    if mode == "rule_only":
        text = F.col("rule_explanation")
    else:
        text = _explanation(F.col("fused_is_attack"), F.col("fused_confidence"), "weighted" if mode == "ml_only" else strategy)
    return out.withColumns({"fusion_strategy": F.lit(strategy), "fusion_explanation": text})
