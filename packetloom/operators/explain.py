"""Readable evidence for verdicts, knowledge-base context, port risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.labels import explanation_severity
from packetloom.functions.text import format_value


def attack_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in K.ATTACK_CATALOGUE.items()]
    return spark.createDataFrame(
        rows, "cat_key string, cat_name string, cat_text string, cat_severity string, cat_advice array<string>"
    )


def knowledge_base(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, None) for k, v in K.ATTACK_KNOWLEDGE.items()]
    return spark.createDataFrame(
        rows, "kb_key string, kb_name string, kb_description string, kb_harm string, kb_defense string, "
        "kb_indicators string"
    )


def port_table(spark: SparkSession) -> DataFrame:
    ports = sorted(set(K.SERVICE_NAMES) | set(K.HIGH_RISK_PORTS))
    rows = [(p, K.SERVICE_NAMES.get(p), p in K.HIGH_RISK_PORTS) for p in ports]
    return spark.createDataFrame(rows, "port int, known_service string, is_high_risk boolean")


def with_catalogue(df: DataFrame, attack_type: str) -> DataFrame:
    """EXP1 lookup: the catalogue is a seven-row fixed table, so it broadcasts."""
    key = F.replace(F.upper(F.col(attack_type)), F.lit("_DETECTION"), F.lit(""))
    known = F.when(key.isin(*K.ATTACK_CATALOGUE), key).otherwise(F.lit("NORMAL"))
    return (
        df.withColumns({"__type": key, "cat_key": known})
        .join(F.broadcast(attack_catalogue(df.sparkSession)), "cat_key", "left")
        .drop("cat_key")
    )


def detail_lines(df: DataFrame, triggers: str | None, model_type: str | None, model_confidence: str | None) -> Column:
    """EXP3: rule evidence, model verdict, monitored rates present."""
    none = F.array().cast("array<string>")
    parts = []
    if triggers:
        lines = F.transform(
            triggers,
            lambda t: F.concat(
                F.lit("- "), t["rule_name"], F.lit(": "), t["description"], F.lit(" (severity="), t["severity"], F.lit(")")
            ),
        )
        parts.append(F.when(F.size(triggers) > 0, F.concat(F.array(F.lit(K.RULE_DETAIL_TITLE)), lines)).otherwise(none))
    if model_type:
        parts.append(
            F.array(
                F.concat(
                    F.lit(K.MODEL_DETAIL_TITLE), F.col(model_type), F.lit(" (confidence="),
                    format_value(F.col(model_confidence), ".2f"), F.lit(")"),
                )
            )
        )
    shown = [c for c in K.RATE_FEATURES if c in df.columns]
    if shown:
        lines = F.filter(
            F.array(*[F.concat(F.lit(f"- {c}="), F.col(c).cast("string")) for c in shown]), lambda x: x.isNotNull()
        )
        parts.append(F.when(F.size(lines) > 0, F.concat(F.array(F.lit(K.FEATURE_DETAIL_TITLE)), lines)).otherwise(none))
    if not parts:
        return F.array(F.lit(K.NO_DETAIL))
    joined = F.concat(*parts)
    return F.when(F.size(joined) > 0, joined).otherwise(F.array(F.lit(K.NO_DETAIL)))


def explain(
    df: DataFrame,
    attack_type: str = "fused_attack_type",
    confidence: str = "fused_confidence",
    is_attack: str = "fused_is_attack",
    triggers: str | None = "triggers",
    model_type: str | None = "model_attack_type",
    model_confidence: str | None = "model_confidence",
    strategy: Column | None = None,
) -> DataFrame:
    """EXP1-4: display name, severity, summary, details and recommendations."""
    conf = F.col(confidence)
    out = with_catalogue(df, attack_type)
    normal = F.col("__type") == "NORMAL"
    found, at, end = K.DETECTED_SUMMARY
    summary = F.when(normal, F.lit(K.NORMAL_SUMMARY)).otherwise(
        F.concat(
            F.lit(found), F.col("cat_name"), F.lit(at), format_value(conf, ".1%"), F.lit(end), F.col("cat_text")
        )
    )
    advice = F.when((conf < 0.5) & ~normal, F.concat(F.array(F.lit(K.VERIFY_ADVICE)), F.col("cat_advice"))).otherwise(
        F.col("cat_advice")
    )
    technical = {
        "is_attack": F.col(is_attack).cast("string"),
        "confidence": conf.cast("string"),
        "fusion_strategy": strategy if strategy is not None else F.lit("unknown"),
    }
    pairs = [x for k, v in technical.items() for x in (F.lit(k), v)]
    return out.withColumns(
        {
            "exp_name": F.col("cat_name"),
            "exp_severity": explanation_severity(conf, F.col("cat_severity")),
            "exp_summary": summary,
            "exp_details": detail_lines(df, triggers, model_type, model_confidence),
            "exp_recommendations": advice,
            "exp_technical": F.create_map(*pairs),
        }
    ).drop("__type", "cat_name", "cat_text", "cat_severity", "cat_advice")


def report_text() -> Column:
    """EXP5: the explanation as one report."""
    bar = F.lit("=" * 64)
    numbered = F.transform(
        "exp_recommendations", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    )
    return F.concat_ws(
        "\n", bar, F.concat(F.lit("Security Detection Report: "), F.col("exp_name")), bar,
        F.concat(F.lit("Severity: "), F.upper("exp_severity")), F.lit(""),
        F.concat(F.lit("Summary: "), F.col("exp_summary")), F.lit(""), F.lit("Details:"), F.col("exp_details"),
        F.lit(""), F.lit("Recommendations:"), numbered, bar,
    )


def enrich_knowledge(df: DataFrame, attack_type: str, kb: DataFrame | None = None) -> DataFrame:
    """EXP6: knowledge-base entry per event, the "unknown" entry as fallback.

    The built-in base is a fixed eight-row table and broadcasts; a caller's
    own base joins without a hint.
    """
    if kb is None:
        kb, small = knowledge_base(df.sparkSession), True
        known = F.col(attack_type).isin(*K.ATTACK_KNOWLEDGE)
        keyed = df.withColumn("kb_key", F.when(known, F.col(attack_type)).otherwise(F.lit("unknown")))
        return keyed.join(F.broadcast(kb), "kb_key", "left")
    fallback = kb.where(F.col("kb_key") == "unknown").limit(1)
    names = [c for c in kb.columns if c != "kb_key"]
    other = fallback.select(F.lit(True).alias("__one"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = df.withColumn("kb_key", F.col(attack_type)).join(kb, "kb_key", "left")
    joined = joined.withColumn("__one", F.lit(True)).join(F.broadcast(other), "__one", "left").drop("__one")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in names}).drop(
        *[f"__{c}" for c in names]
    )


def report_context(is_attack: Column, confidence: Column, severity: Column, summary: Column) -> Column:
    """EXP6: text block handed to a report writer."""
    line = lambda title, c: F.concat(F.lit(title), F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws(
        "\n",
        line("是否攻击：", is_attack),
        line("攻击类型：", F.col("kb_name")),
        line("置信度：", format_value(F.coalesce(confidence, F.lit(0.0)), ".2f")),
        line("风险等级：", severity),
        line("系统摘要：", summary),
        line("典型技术特征：", F.coalesce(F.col("kb_indicators"), F.lit(K.NO_INDICATORS))),
        F.col("kb_description"),
        line("危害：", F.col("kb_harm")),
        line("防御：", F.col("kb_defense")),
    )


def classify_ports(findings: DataFrame) -> DataFrame:
    """RSK1: risk class and service name per finding; the port table is fixed."""
    risky = F.coalesce(F.col("is_high_risk"), F.lit(False))
    risk = (
        F.when(F.col("state") != "open", F.lit("low")).when(risky, F.lit("high")).otherwise(F.lit("medium"))
    )
    return (
        findings.join(F.broadcast(port_table(findings.sparkSession)), "port", "left")
        .withColumns({"service": F.coalesce(F.col("known_service"), F.lit("unknown")), "risk": risk})
        .drop("known_service", "is_high_risk")
    )


def scan_summary(classified: DataFrame, by: list[str]) -> DataFrame:
    """RSK2: counters per scan."""
    texts = [
        "count(DISTINCT target) AS target_count",
        "count(DISTINCT port) AS port_count",
        "count(1) AS total_probes",
        "count_if(state = 'open') AS open_port_count",
        "count_if(risk = 'high') AS high_risk_open_port_count",
        "count_if(state = 'error') AS error_count",
    ]
    return classified.groupBy(*by).agg(*[F.expr(t) for t in texts])


def scan_recommendations(summary: DataFrame) -> DataFrame:
    """RSK3: advice from the counters."""
    lit = F.lit
    base = (
        F.when(F.col("high_risk_open_port_count") > 0, F.array(lit(K.ADVICE_LIMIT_EXPOSURE), lit(K.ADVICE_STRONG_AUTH)))
        .when(F.col("open_port_count") > 0, F.array(lit(K.ADVICE_REVIEW_PORTS)))
        .otherwise(F.array(lit(K.ADVICE_KEEP_CHECKING)))
    )
    retry = F.when(F.col("error_count") > 0, F.array(lit(K.ADVICE_RETRY))).otherwise(F.array().cast("array<string>"))
    return summary.withColumn("recommendations", F.concat(base, retry))
