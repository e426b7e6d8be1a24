"""Threshold and payload rules as pure column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import constants as K
from packetloom.functions.numeric import rate_input, whole_text

RULE_COLUMNS = ["rule_is_attack", "rule_attack_type", "rule_confidence", "rule_explanation", "triggers"]


def merge_config(config: dict | None) -> tuple[dict[str, float], list[str]]:
    """RUL9: overrides on top of the default thresholds and keywords."""
    config = config or {}
    thresholds = dict(K.RULE_THRESHOLDS)
    for name, value in (config.get("rule_thresholds") or {}).items():
        thresholds[name] = float(value)
    return thresholds, list(config.get("sql_injection_keywords", K.SQL_KEYWORDS))


def _input(df: DataFrame, name: str) -> Column:
    """Rate as a double; what is no number counts as 0."""
    if name not in df.columns:
        return F.lit(0.0)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return rate_input(F.col(name))


def _per_minute(df: DataFrame, name: str) -> Column:
    """Counted rates become per-minute rates where the unit column says so."""
    raw = _input(df, name)
    unit = f"{name}_unit"
    if unit not in df.columns:
        return raw
    window = F.col("window_seconds") if "window_seconds" in df.columns else F.lit(1.0)
    seconds = F.greatest(F.coalesce(F.nanvl(window.cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(0.001))
    return F.when(F.lower(F.col(unit)).isin("per_sec", "sec", "s"), raw * (F.lit(60.0) / seconds)).otherwise(raw)


def payload_hits(text: Column, keywords: list[str]) -> Column:
    """Number of distinct keywords found in a lower-case text."""
    hits = [F.contains(text, F.lit(word.lower())).cast("int") for word in dict.fromkeys(keywords)]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total.cast("double")


@dataclass
class Rule:
    """One rule over prepared columns: ``value`` against ``limit``."""

    name: str
    value: str
    limit: float
    text: list[str]  # literal text alternating with value columns
    fires: str | None = None  # SQL condition where it is not "value >= limit"

    @property
    def condition(self) -> str:
        return self.fires or f"{self.value} >= {self.limit!r}D"

    @property
    def level(self) -> Column:
        """0 silent, 1 high, 2 critical."""
        return F.expr(f"CASE WHEN {self.condition} THEN if({self.value} >= {2 * self.limit!r}D, 2, 1) ELSE 0 END")

    def description(self) -> Column:
        parts = [whole_text(F.col(t)) if i % 2 else F.lit(t) for i, t in enumerate(self.text)]
        return F.when(F.col(f"__l_{self.name}") > 0, F.concat(*parts))

    def severity(self) -> Column:
        return F.when(F.col(f"__l_{self.name}") == 2, F.lit("critical")).otherwise(F.lit("high"))


def _rules(limits: dict[str, float], with_payload: bool) -> list[Rule]:
    """RUL1-6 in report order."""
    syn, udp, dns, ntp, sql, pkt = (limits[k] for k in K.RULE_THRESHOLDS)
    rules = [
        Rule("SYN_FLOOD", "__syn", syn, ["SYN rate ", "__syn", f"/s exceeds threshold {syn:.0f}/s."]),
        Rule("UDP_FLOOD", "__udp", udp, ["UDP rate normalized to ", "__udp", f"/min exceeds threshold {udp:.0f}/min."]),
        Rule("DNS_FLOOD", "__dns", dns, ["DNS query rate ", "__dns", f"/s exceeds threshold {dns:.0f}/s."]),
        Rule("NTP_FLOOD", "__ntp", ntp,
             ["NTP query rate normalized to ", "__ntp", f"/min exceeds threshold {ntp:.0f}/min."]),
    ]
    if with_payload:
        rules.append(Rule("SQL_INJECTION", "__hits", sql,
                          ["SQL injection indicators matched ", "__hits", f" times (threshold {sql:.0f})."]))
    rules.append(Rule(
        "ANOMALY", "__pkt", pkt,
        ["Abnormal traffic pattern detected: pkt_rate=", "__pkt", "/s, avg_pkt_size=", "__size", " bytes."],
        fires=f"__pkt > {pkt!r}D AND __size < {K.TINY_PACKET_BYTES!r}D",
    ))
    return rules


def _leveled(df: DataFrame, config: dict | None) -> tuple[DataFrame, list[Rule]]:
    """Staged inputs and one level column per rule."""
    limits, keywords = merge_config(config)
    payloads = [F.col(c).cast("string") for c in ("payload", "http_payload") if c in df.columns]
    inputs = {
        "__syn": _input(df, "syn_rate"), "__udp": _per_minute(df, "udp_rate"), "__dns": _input(df, "dns_rate"),
        "__ntp": _per_minute(df, "ntp_rate"), "__pkt": _input(df, "pkt_rate"), "__size": _input(df, "avg_pkt_size"),
    }
    work = df
    if payloads:
        work = work.withColumn("__payload", F.lower(F.coalesce(*payloads)))
        inputs["__hits"] = payload_hits(F.col("__payload"), keywords)
    rules = _rules(limits, bool(payloads))
    return work.withColumns(inputs).withColumns({f"__l_{r.name}": r.level for r in rules}), rules


def apply_rules(df: DataFrame, config: dict | None = None) -> DataFrame:
    """RUL1-8: fired triggers in order and the combined verdict.

    Inputs, levels and texts are staged columns, so each is computed once and
    unused ones are pruned. The verdict is the first trigger of the highest
    level.
    """
    work, rules = _leveled(df, config)
    levels = [f"__l_{r.name}" for r in rules]
    fired = F.expr(" + ".join(f"int({c} > 0)" for c in levels))
    work = work.withColumns(
        {**{f"__d_{r.name}": r.description() for r in rules}, "__n": fired, "__top": F.greatest(*levels)}
    )
    kind = F.lit("NORMAL")
    for r in reversed(rules):
        kind = F.when((F.col(f"__l_{r.name}") == F.col("__top")) & (F.col("__n") > 0), F.lit(r.name)).otherwise(kind)
    rank = F.when(F.col("__top") == 2, K.SEVERITY_RANK["critical"]).otherwise(K.SEVERITY_RANK["high"])
    lines = [
        F.when(F.col(f"__l_{r.name}") > 0,
               F.concat(F.lit("- "), F.col(f"__d_{r.name}"), F.lit(" (severity="), r.severity(), F.lit(")")))
        for r in rules
    ]
    triggers = [
        F.when(
            F.col(f"__l_{r.name}") > 0,
            F.struct(
                F.lit(f"{r.name}_DETECTION").alias("rule_name"), F.lit(r.limit).alias("threshold"),
                F.col(r.value).alias("actual_value"), r.severity().alias("severity"),
                F.col(f"__d_{r.name}").alias("description"),
            ),
        )
        for r in rules
    ]
    none = F.lit("No rule-based attack evidence was found.")
    out = work.withColumns(
        {
            "triggers": F.array_compact(F.array(*triggers)),
            "rule_is_attack": F.col("__n") > 0,
            "rule_attack_type": kind,
            "rule_confidence": F.when(
                F.col("__n") > 0, F.least(F.lit(1.0), F.col("__n") * F.lit(0.2) + rank * F.lit(0.15))
            ).otherwise(F.lit(0.0)),
            "rule_explanation": F.when(F.col("__n") > 0, F.concat_ws("\n", F.lit("Rule evidence:"), *lines)).otherwise(none),
        }
    )
    return out.select(*df.columns, *RULE_COLUMNS)


def trigger_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """RUL10 for rows that ``apply_rules`` has judged: one row per fired rule."""
    return df.select(*keys, F.posexplode("triggers").alias("trigger_no", "t")).select(
        *keys, "trigger_no", "t.rule_name", "t.threshold", "t.actual_value", "t.severity", "t.description"
    )


def fired_rules(df: DataFrame, keys: list[str], config: dict | None = None) -> DataFrame:
    """RUL10: one row per fired rule.

    The rule numbers are exploded first; only rows of fired rules build their
    one text, all inside generated code.
    """
    work, rules = _leveled(df, config)
    cells, before = [], F.lit(0)
    for i, r in enumerate(rules):
        level = F.col(f"__l_{r.name}")
        cells.append(F.struct(F.lit(i).alias("__rule"), level.alias("__level"), before.alias("trigger_no")))
        before = before + (level > 0).cast("int")
    rows = work.select("*", F.inline(F.array(*cells))).where(F.col("__level") > 0)

    def pick(value) -> Column:
        out = value(rules[-1])
        for i in range(len(rules) - 2, -1, -1):
            out = F.when(F.col("__rule") == i, value(rules[i])).otherwise(out)
        return out

    return rows.select(
        *keys, "trigger_no",
        pick(lambda r: F.lit(f"{r.name}_DETECTION")).alias("rule_name"), pick(lambda r: F.lit(r.limit)).alias("threshold"),
        pick(lambda r: F.col(r.value)).alias("actual_value"),
        F.when(F.col("__level") == 2, F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        pick(lambda r: r.description()).alias("description"),
    )


def rule_only_verdict(df: DataFrame) -> DataFrame:
    """FUS7: verdict columns when no model is available."""
    return df.withColumns(
        {
            "prediction": F.col("rule_is_attack").cast("int"),
            "prediction_label": F.col("rule_attack_type"),
            "confidence": F.col("rule_confidence"),
            "is_attack": F.col("rule_is_attack"),
        }
    )
