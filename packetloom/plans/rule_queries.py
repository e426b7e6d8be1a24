"""Rule, fusion, explanation and port risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.metrics import dynamic_metrics
from packetloom.operators.explain import (
    classify_ports,
    enrich_knowledge,
    explain,
    report_context,
    report_text,
    scan_recommendations,
    scan_summary,
)
from packetloom.operators.fusion import fuse, model_side
from packetloom.operators.records import detection_output
from packetloom.operators.rules import apply_rules, fired_rules, rule_only_verdict, trigger_table
from packetloom.plans.registry import query, rounded, sql_text
from packetloom.sources.adapters import adapter, oracle_cte

KEYS = ["l_orderkey", "l_linenumber"]
KEYS_SQL = "l_orderkey, l_linenumber"

# name, condition, value, threshold, description
RULES = [
    ("SYN_FLOOD", "syn_rate >= 500", "syn_rate", 500.0,
     "printf('SYN rate %.0f/s exceeds threshold 500/s.', syn_rate)"),
    ("UDP_FLOOD", "udp_rate >= 10000", "udp_rate", 10000.0,
     "printf('UDP rate normalized to %.0f/min exceeds threshold 10000/min.', udp_rate)"),
    ("DNS_FLOOD", "dns_rate >= 2000", "dns_rate", 2000.0,
     "printf('DNS query rate %.0f/s exceeds threshold 2000/s.', dns_rate)"),
    ("NTP_FLOOD", "ntp_rate >= 5000", "ntp_rate", 5000.0,
     "printf('NTP query rate normalized to %.0f/min exceeds threshold 5000/min.', ntp_rate)"),
    ("ANOMALY", "pkt_rate > 10000 AND avg_pkt_size < 100", "pkt_rate", 10000.0,
     "printf('Abnormal traffic pattern detected: pkt_rate=%.0f/s, avg_pkt_size=%.0f bytes.', pkt_rate, avg_pkt_size)"),
]


def trigger_sql(rule, source="rate_features", keys=KEYS_SQL) -> str:
    name, cond, value, limit, text = rule
    return (
        f"SELECT {keys}, '{name}_DETECTION' AS rule_name, {limit}::DOUBLE AS threshold, round({value}, 6) AS actual_value, "
        f"CASE WHEN {value} >= {2 * limit} THEN 'critical' ELSE 'high' END AS severity, {text} AS description "
        f"FROM {source} WHERE {cond}"
    )


def _single_rule(name):
    def run(spark, sf_dir):
        rows = trigger_table(apply_rules(adapter(spark, sf_dir, "rate_features")), KEYS).drop("trigger_no")
        return rounded(rows.where(F.col("rule_name") == f"{name}_DETECTION"))

    run.__doc__ = f"RUL: rows on which {name} fires."
    return run


for _rule in RULES:
    query(f"rule_{_rule[0].lower()}", f"{oracle_cte('rate_features')} {trigger_sql(_rule)}")(_single_rule(_rule[0]))


@query("rule_triggers", f"{oracle_cte('rate_features')} " + " UNION ALL ".join(trigger_sql(r) for r in RULES))
def rule_triggers(spark, sf_dir):
    """RUL10: one row per fired rule."""
    return rounded(fired_rules(adapter(spark, sf_dir, "rate_features"), KEYS).drop("trigger_no"))


PER_SEC = "SELECT *, 'per_sec' AS udp_rate_unit, 'sec' AS ntp_rate_unit FROM rate_features"


@query(
    "rule_unit_aware",
    f"{oracle_cte('rate_features')}, r AS (SELECT {KEYS_SQL}, udp_rate / 100 * 60 AS udp_rate, ntp_rate / 100 * 60 AS ntp_rate "
    f"FROM rate_features) {trigger_sql(RULES[1], 'r')} UNION ALL {trigger_sql(RULES[3], 'r')}",
)
def rule_unit_aware(spark, sf_dir):
    """RUL2, RUL4: per-second counts scaled to a minute."""
    rates = adapter(spark, sf_dir, "rate_features").selectExpr(
        *KEYS, "udp_rate / 100 AS udp_rate", "ntp_rate / 100 AS ntp_rate", "window_seconds",
        "'per_sec' AS udp_rate_unit", "'SEC' AS ntp_rate_unit",
    )
    rows = trigger_table(apply_rules(rates), KEYS).drop("trigger_no")
    return rounded(rows)


VERDICT_CTE = f"""{oracle_cte('rate_features')},
r AS (SELECT *, CASE WHEN syn_rate >= 1000 THEN 2 WHEN syn_rate >= 500 THEN 1 ELSE 0 END AS s,
  CASE WHEN udp_rate >= 20000 THEN 2 WHEN udp_rate >= 10000 THEN 1 ELSE 0 END AS u,
  CASE WHEN dns_rate >= 4000 THEN 2 WHEN dns_rate >= 2000 THEN 1 ELSE 0 END AS d,
  CASE WHEN ntp_rate >= 10000 THEN 2 WHEN ntp_rate >= 5000 THEN 1 ELSE 0 END AS n,
  CASE WHEN pkt_rate > 10000 AND avg_pkt_size < 100 THEN CASE WHEN pkt_rate >= 20000 THEN 2 ELSE 1 END ELSE 0 END AS a
  FROM rate_features),
h AS (SELECT *, (s > 0)::INT + (u > 0)::INT + (d > 0)::INT + (n > 0)::INT + (a > 0)::INT AS hits, greatest(s, u, d, n, a) AS top FROM r),
v AS (SELECT *, hits > 0 AS rule_is_attack,
  CASE WHEN hits = 0 THEN 'NORMAL' WHEN s = top THEN 'SYN_FLOOD' WHEN u = top THEN 'UDP_FLOOD' WHEN d = top THEN 'DNS_FLOOD'
    WHEN n = top THEN 'NTP_FLOOD' ELSE 'ANOMALY' END AS rule_attack_type,
  (CASE WHEN hits = 0 THEN 0.0 ELSE least(1.0, 0.2 * hits + CASE WHEN top = 2 THEN 0.6 ELSE 0.45 END) END)::DOUBLE AS rule_confidence,
  CASE WHEN hits = 0 THEN 'No rule-based attack evidence was found.' ELSE concat_ws(chr(10), 'Rule evidence:',
    CASE WHEN s > 0 THEN printf('- SYN rate %.0f/s exceeds threshold 500/s. (severity=%s)', syn_rate, CASE s WHEN 2 THEN 'critical' ELSE 'high' END) END,
    CASE WHEN u > 0 THEN printf('- UDP rate normalized to %.0f/min exceeds threshold 10000/min. (severity=%s)', udp_rate, CASE u WHEN 2 THEN 'critical' ELSE 'high' END) END,
    CASE WHEN d > 0 THEN printf('- DNS query rate %.0f/s exceeds threshold 2000/s. (severity=%s)', dns_rate, CASE d WHEN 2 THEN 'critical' ELSE 'high' END) END,
    CASE WHEN n > 0 THEN printf('- NTP query rate normalized to %.0f/min exceeds threshold 5000/min. (severity=%s)', ntp_rate, CASE n WHEN 2 THEN 'critical' ELSE 'high' END) END,
    CASE WHEN a > 0 THEN printf('- Abnormal traffic pattern detected: pkt_rate=%.0f/s, avg_pkt_size=%.0f bytes. (severity=%s)', pkt_rate, avg_pkt_size, CASE a WHEN 2 THEN 'critical' ELSE 'high' END) END) END AS rule_explanation
  FROM h)"""


@query(
    "rules_verdict",
    f"{VERDICT_CTE} SELECT {KEYS_SQL}, rule_is_attack, rule_attack_type, round(rule_confidence, 6) AS rule_confidence, "
    "hits AS n_triggers FROM v",
)
def rules_verdict(spark, sf_dir):
    """RUL7: combined verdict of all rules."""
    out = apply_rules(adapter(spark, sf_dir, "rate_features"))
    return rounded(out.select(*KEYS, "rule_is_attack", "rule_attack_type", "rule_confidence", F.size("triggers").alias("n_triggers")))


@query("rule_evidence", f"{VERDICT_CTE} SELECT {KEYS_SQL}, rule_explanation FROM v")
def rule_evidence(spark, sf_dir):
    """RUL8: evidence text."""
    return apply_rules(adapter(spark, sf_dir, "rate_features")).select(*KEYS, "rule_explanation")


@query(
    "rule_overrides",
    f"{oracle_cte('rate_features')} SELECT {KEYS_SQL}, syn_rate >= 100 OR udp_rate >= 10000 OR dns_rate >= 2000 "
    "OR ntp_rate >= 5000 OR (pkt_rate > 2500 AND avg_pkt_size < 100) AS rule_is_attack, "
    "(syn_rate >= 100)::INT + (udp_rate >= 10000)::INT + (dns_rate >= 2000)::INT + (ntp_rate >= 5000)::INT "
    "+ (pkt_rate > 2500 AND avg_pkt_size < 100)::INT AS n_triggers FROM rate_features",
)
def rule_overrides(spark, sf_dir):
    """RUL9: some thresholds overridden, the rest default."""
    config = {"rule_thresholds": {"syn_flood_per_sec": 100, "pkt_anomaly_per_sec": 2500}}
    out = apply_rules(adapter(spark, sf_dir, "rate_features"), config)
    return out.select(*KEYS, "rule_is_attack", F.size("triggers").alias("n_triggers"))


HITS = " + ".join(f"(contains(lower(payload), {sql_text(w)}))::INT" for w in K.SQL_KEYWORDS)


@query(
    "sqli_payloads",
    f"{oracle_cte('payloads')}, h AS (SELECT payload_id, {HITS} AS hits FROM payloads) "
    "SELECT payload_id, coalesce(hits >= 2, false) AS fires, CASE WHEN hits >= 2 THEN hits END::DOUBLE AS hits, "
    "CASE WHEN hits >= 4 THEN 'critical' WHEN hits >= 2 THEN 'high' END AS severity FROM h",
)
def sqli_payloads(spark, sf_dir):
    """RUL5: distinct SQL keywords over whole payload texts."""
    out = apply_rules(adapter(spark, sf_dir, "payloads"))
    top = F.get("triggers", F.lit(0))
    return out.select(
        "payload_id", F.col("rule_is_attack").alias("fires"), top["actual_value"].alias("hits"), top["severity"].alias("severity")
    )


FUSION_CTE = VERDICT_CTE + """,
m AS (SELECT *, CASE rule_attack_type WHEN 'ANOMALY' THEN 'DDOS' ELSE rule_attack_type END AS rt,
  ml_label AS mt, lower(ml_label) NOT IN ('normal', 'benign', '0') AS ma FROM v),
w AS (SELECT *, (0.4::DOUBLE * CASE WHEN rule_is_attack THEN rule_confidence ELSE 0 END
  + 0.6::DOUBLE * CASE WHEN ma THEN ml_confidence ELSE 0 END) / 1.0 AS wc FROM m),
f AS (SELECT *,
  CASE WHEN wc < 0.5 AND NOT (rule_is_attack AND ma) THEN 'NORMAL' WHEN rule_is_attack THEN rt WHEN ma THEN mt ELSE 'NORMAL' END AS w_type,
  rule_is_attack OR ma AS v_attack,
  CASE WHEN rule_is_attack THEN rt WHEN ma THEN mt ELSE 'NORMAL' END AS v_type,
  CASE WHEN rule_is_attack OR ma THEN greatest(rule_confidence, ml_confidence) ELSE (rule_confidence + ml_confidence) / 2 END AS v_conf
  FROM w),
e AS (SELECT *, w_type <> 'NORMAL' AS w_attack, concat_ws(chr(10),
  CASE WHEN rule_is_attack THEN printf('Rule engine: %s (confidence=%.2f)', rt, rule_confidence) || chr(10) || rule_explanation ELSE 'Rule engine: NORMAL' END,
  printf('ML detector: %s (confidence=%.2f)', mt, ml_confidence),
  printf('Fusion verdict: %s (confidence=%.2f, strategy=weighted)', CASE WHEN w_type <> 'NORMAL' THEN 'ATTACK' ELSE 'NORMAL' END, round(wc, 6))) AS w_text
  FROM f)"""


def _judged(spark, sf_dir):
    return model_side(apply_rules(adapter(spark, sf_dir, "rate_features")))


def _verdict_sql(attack, kind, conf):
    return (f"{FUSION_CTE} SELECT {KEYS_SQL}, {attack} AS is_attack, {kind} AS attack_type, "
            f"round({conf}, 6) AS confidence FROM e")


def _verdict(df):
    return rounded(df.select(
        *KEYS, F.col("fused_is_attack").alias("is_attack"), F.col("fused_attack_type").alias("attack_type"),
        F.col("fused_confidence").alias("confidence"),
    ))


FUSIONS = {
    "fuse_weighted": ("weighted", "FUS1", _verdict_sql("w_attack", "w_type", "wc")),
    "fuse_voting": ("voting", "FUS2", _verdict_sql("v_attack", "v_type", "v_conf")),
    "fuse_rule_only": ("rule_only", "FUS3", _verdict_sql("rule_is_attack", "rt", "rule_confidence")),
    "fuse_ml_only": ("ml_only", "FUS3", _verdict_sql("ma", "mt", "ml_confidence")),
}


def _fusion_query(mode, ids):
    def run(spark, sf_dir):
        return _verdict(fuse(_judged(spark, sf_dir), mode))

    run.__doc__ = f"{ids}: {mode} verdict."
    return run


for _name, (_mode, _ids, _sql) in FUSIONS.items():
    query(_name, _sql)(_fusion_query(_mode, _ids))


@query("fusion_text", f"{FUSION_CTE} SELECT {KEYS_SQL}, w_text AS fusion_explanation FROM e")
def fusion_text(spark, sf_dir):
    """FUS5: fusion explanation."""
    return fuse(_judged(spark, sf_dir), "weighted").select(*KEYS, "fusion_explanation")


@query(
    "fuse_missing_features",
    f"{oracle_cte('cic_rows')}, x AS (SELECT row_id, label, flow_bytes_s_raw, coalesce(packet_length_mean IS NOT NULL "
    "AND flow_bytes_s_raw <> '', false) AS usable FROM cic_rows) "
    "SELECT row_id, flow_bytes_s_raw, CASE WHEN usable THEN label ELSE 'NORMAL' END AS model_attack_type, "
    "usable AND label <> 'BENIGN' AS model_is_attack, CASE WHEN usable THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS model_confidence FROM x",
)
def fuse_missing_features(spark, sf_dir):
    """FUS4: the model side is NORMAL / 0 when a fitted column is no number."""
    rows = adapter(spark, sf_dir, "cic_rows").withColumn("ml_confidence", F.lit(0.75))
    out = model_side(rows, "label", "ml_confidence", required=["packet_length_mean", "flow_bytes_s_raw"])
    return out.select("row_id", "flow_bytes_s_raw", "model_attack_type", "model_is_attack", "model_confidence")


@query(
    "rule_fallback",
    f"{VERDICT_CTE} SELECT {KEYS_SQL}, rule_is_attack::INT AS prediction, rule_attack_type AS prediction_label, "
    "round(rule_confidence, 6) AS confidence, rule_is_attack AS is_attack FROM v",
)
def rule_fallback(spark, sf_dir):
    """FUS7: rules-only verdict without a model."""
    out = rule_only_verdict(apply_rules(adapter(spark, sf_dir, "rate_features")))
    return rounded(out.select(*KEYS, "prediction", "prediction_label", "confidence", "is_attack"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(sql_text(v) if isinstance(v, str) else "[" + ", ".join(map(sql_text, v)) + "]" for v in r) + ")" for r in rows)


CATALOGUE = _values((k, *v) for k, v in K.ATTACK_CATALOGUE.items())
FOUND, AT, END = K.DETECTED_SUMMARY
EXPLAIN_CTE = FUSION_CTE + f""",
c(ck, cname, ctext, csev, cadv) AS (VALUES {CATALOGUE}),
x AS (SELECT e.*, c.*, CASE WHEN wc >= 0.85 THEN 'critical' WHEN wc >= 0.65 THEN 'high' WHEN wc >= 0.45 THEN 'medium' ELSE csev END AS exp_severity,
  CASE WHEN w_type = 'NORMAL' THEN {sql_text(K.NORMAL_SUMMARY)} ELSE {sql_text(FOUND)} || cname || {sql_text(AT)} || printf('%.1f%%', round(wc * 100, 4)) || {sql_text(END)} || ctext END AS exp_summary,
  CASE WHEN wc < 0.5 AND w_type <> 'NORMAL' THEN list_concat([{sql_text(K.VERIFY_ADVICE)}], cadv) ELSE cadv END AS advice
  FROM e JOIN c ON ck = CASE WHEN w_type IN ('SYN_FLOOD', 'UDP_FLOOD', 'DNS_FLOOD', 'NTP_FLOOD', 'DDOS', 'SQL_INJECTION', 'NORMAL') THEN w_type ELSE 'NORMAL' END)"""


def _explained(spark, sf_dir):
    return explain(fuse(_judged(spark, sf_dir), "weighted"), strategy=F.col("fusion_strategy"))


@query(
    "explain",
    f"{EXPLAIN_CTE} SELECT {KEYS_SQL}, cname AS exp_name, exp_severity, exp_summary, array_to_string(advice, '|') AS advice FROM x",
)
def explain_query(spark, sf_dir):
    """EXP1, EXP2, EXP4: catalogue entry, severity, summary and advice."""
    return _explained(spark, sf_dir).select(
        *KEYS, "exp_name", "exp_severity", "exp_summary", F.array_join("exp_recommendations", "|").alias("advice")
    )


DETAILS_SQL = f"""concat_ws('|', CASE WHEN hits > 0 THEN {sql_text(K.RULE_DETAIL_TITLE)} END,
  CASE WHEN s > 0 THEN printf('- SYN_FLOOD_DETECTION: SYN rate %.0f/s exceeds threshold 500/s. (severity=%s)', syn_rate, CASE s WHEN 2 THEN 'critical' ELSE 'high' END) END,
  CASE WHEN u > 0 THEN printf('- UDP_FLOOD_DETECTION: UDP rate normalized to %.0f/min exceeds threshold 10000/min. (severity=%s)', udp_rate, CASE u WHEN 2 THEN 'critical' ELSE 'high' END) END,
  CASE WHEN d > 0 THEN printf('- DNS_FLOOD_DETECTION: DNS query rate %.0f/s exceeds threshold 2000/s. (severity=%s)', dns_rate, CASE d WHEN 2 THEN 'critical' ELSE 'high' END) END,
  CASE WHEN n > 0 THEN printf('- NTP_FLOOD_DETECTION: NTP query rate normalized to %.0f/min exceeds threshold 5000/min. (severity=%s)', ntp_rate, CASE n WHEN 2 THEN 'critical' ELSE 'high' END) END,
  CASE WHEN a > 0 THEN printf('- ANOMALY_DETECTION: Abnormal traffic pattern detected: pkt_rate=%.0f/s, avg_pkt_size=%.0f bytes. (severity=%s)', pkt_rate, avg_pkt_size, CASE a WHEN 2 THEN 'critical' ELSE 'high' END) END,
  printf('{K.MODEL_DETAIL_TITLE}%s (confidence=%.2f)', mt, ml_confidence), {sql_text(K.FEATURE_DETAIL_TITLE)},
  {', '.join(f"'- {c}=' || {c}::VARCHAR" for c in K.RATE_FEATURES)})"""


@query("explain_details", f"{EXPLAIN_CTE} SELECT {KEYS_SQL}, {DETAILS_SQL} AS details FROM x")
def explain_details(spark, sf_dir):
    """EXP3: evidence lines and the monitored rates."""
    return _explained(spark, sf_dir).select(*KEYS, F.array_join("exp_details", "|").alias("details"))


@query(
    "report_text",
    f"{EXPLAIN_CTE} SELECT {KEYS_SQL}, concat_ws(chr(10), repeat('=', 64), 'Security Detection Report: ' || cname, repeat('=', 64), "
    f"'Severity: ' || upper(exp_severity), '', 'Summary: ' || exp_summary, '', 'Details:', replace({DETAILS_SQL}, '|', chr(10)), '', "
    "'Recommendations:', array_to_string(list_transform(range(1, len(advice) + 1), lambda i: i || '. ' || advice[i]), chr(10)), "
    "repeat('=', 64)) AS report FROM x",
)
def report_text_query(spark, sf_dir):
    """EXP5: report per detection."""
    return explain(fuse(_judged(spark, sf_dir), "weighted")).select(*KEYS, report_text().alias("report"))


KNOWLEDGE = _values((k, *v) for k, v in K.ATTACK_KNOWLEDGE.items())


@query(
    "knowledge_context",
    f"""{oracle_cte('detections')}, kb(k, kname, kdesc, kharm, kdef) AS (VALUES {KNOWLEDGE}),
d AS (SELECT *, CASE prediction_label WHEN 'SYN_FLOOD' THEN 'synflood' WHEN 'BENIGN' THEN 'normal' ELSE prediction_label END AS kind FROM detections)
SELECT event_uid, kname AS kb_name, concat_ws(chr(10), '是否攻击：' || (lower(prediction_label) NOT IN ('normal', 'benign', '0'))::VARCHAR,
 '攻击类型：' || kname, '置信度：' || printf('%.2f', confidence), '风险等级：high', '系统摘要：' || source,
 '典型技术特征：暂无特定技术指标', kdesc, '危害：' || kharm, '防御：' || kdef) AS context
FROM d JOIN kb ON k = CASE WHEN kind IN ('normal', 'synflood', 'udpflood', 'dnsflood', 'ntpflood', 'portscan', 'ddos') THEN kind ELSE 'unknown' END""",
)
def knowledge_context(spark, sf_dir):
    """EXP6: knowledge-base entry and report context per event."""
    rows = adapter(spark, sf_dir, "detections").selectExpr(
        "*", "CASE prediction_label WHEN 'SYN_FLOOD' THEN 'synflood' WHEN 'BENIGN' THEN 'normal' ELSE prediction_label END AS kind"
    )
    attack = ~F.lower("prediction_label").isin(*K.BENIGN_LABELS)
    text = report_context(attack, F.col("confidence"), F.lit("high"), F.col("source"))
    return enrich_knowledge(rows, "kind").select("event_uid", "kb_name", text.alias("context"))


SERVICES = ", ".join(f"({p}, '{n}')" for p, n in K.SERVICE_NAMES.items())
RISKY = ", ".join(str(p) for p in K.HIGH_RISK_PORTS)
PORTS_CTE = f"""{oracle_cte('scan_findings')}, svc(p, name) AS (VALUES {SERVICES}),
cl AS (SELECT s.*, coalesce(svc.name, 'unknown') AS service, CASE WHEN state <> 'open' THEN 'low' WHEN port IN ({RISKY}) THEN 'high' ELSE 'medium' END AS risk
  FROM scan_findings s LEFT JOIN svc ON svc.p = s.port)"""
SUMMARY_CTE = PORTS_CTE + """, sm AS (SELECT trace_id, count(DISTINCT target) AS target_count, count(DISTINCT port) AS port_count,
  count(*) AS total_probes, count(*) FILTER (state = 'open') AS open_port_count, count(*) FILTER (risk = 'high') AS high_risk_open_port_count,
  count(*) FILTER (state = 'error') AS error_count FROM cl GROUP BY trace_id)"""


@query("port_risk", f"{PORTS_CTE} SELECT trace_id, target, port, protocol, state, service, risk FROM cl")
def port_risk(spark, sf_dir):
    """RSK1: risk class and service per finding."""
    out = classify_ports(adapter(spark, sf_dir, "scan_findings"))
    return out.select("trace_id", "target", "port", "protocol", "state", "service", "risk")


@query("scan_summary", f"{SUMMARY_CTE} SELECT * FROM sm")
def scan_summary_query(spark, sf_dir):
    """RSK2: counters per scan trace."""
    return scan_summary(classify_ports(adapter(spark, sf_dir, "scan_findings")), ["trace_id"])


@query(
    "scan_recommendations",
    f"{SUMMARY_CTE} SELECT trace_id, CASE WHEN high_risk_open_port_count > 0 THEN {sql_text(K.ADVICE_LIMIT_EXPOSURE + '|' + K.ADVICE_STRONG_AUTH)} "
    f"WHEN open_port_count > 0 THEN {sql_text(K.ADVICE_REVIEW_PORTS)} ELSE {sql_text(K.ADVICE_KEEP_CHECKING)} END "
    f"|| CASE WHEN error_count > 0 THEN {sql_text('|' + K.ADVICE_RETRY)} ELSE '' END AS recommendations FROM sm",
)
def scan_recommendations_query(spark, sf_dir):
    """RSK3: advice per scan trace."""
    summary = scan_summary(classify_ports(adapter(spark, sf_dir, "scan_findings")), ["trace_id"])
    return scan_recommendations(summary).select("trace_id", F.array_join("recommendations", "|").alias("recommendations"))


@query(
    "detection_output",
    f"{EXPLAIN_CTE} SELECT 'hub' AS source, 'tr-' || l_orderkey AS trace_id, {KEYS_SQL}, w_attack AS is_attack, w_type AS attack_type, "
    "round(wc, 6) AS confidence, exp_severity AS severity, exp_summary AS summary, len(advice)::INT AS n_recommendations, "
    "round(avg_pkt_size, 6) AS pkt_len, round(syn_rate, 6) AS syn_count, round(udp_rate, 6) AS udp_count, hits AS n_evidence FROM x",
)
def detection_output_query(spark, sf_dir):
    """PRJ22: the agreed output record."""
    base = adapter(spark, sf_dir, "rate_features").selectExpr(
        "*", "'hub' AS source", "concat('tr-', l_orderkey) AS trace_id", "struct(l_orderkey, l_linenumber) AS ts"
    )
    judged = dynamic_metrics(explain(fuse(model_side(apply_rules(base)), "weighted")))
    out = detection_output(judged, ["pkt_len", "syn_count", "udp_count"])
    return rounded(out.select(
        "source", "trace_id", "timestamp.*", "is_attack", "attack_type", "confidence", "severity", "summary",
        F.size("recommendations").alias("n_recommendations"), "dynamic_metrics.*", F.size("rule_evidence").alias("n_evidence"),
    ))
