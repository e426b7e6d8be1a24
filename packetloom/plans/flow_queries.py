"""Flow record and rate feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators.features import extract_features, labelled_features
from packetloom.operators.flows import FLOW_COLUMNS, build_flows, flow_totals, with_flow_key
from packetloom.operators.skew import lag_in_groups
from packetloom.plans.detection import window_verdicts
from packetloom.plans.registry import query, rounded
from packetloom.sources.adapters import adapter, oracle_cte

KEY = "capture_id, lo_ip, lo_port, hi_ip, hi_port, proto"


def _stat(col: str, name: str, total: str | None = None) -> str:
    parts = [f"coalesce({fn}({col}), 0.0)::DOUBLE AS {name}_{stat}" for stat, fn in
             (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_pop"))]
    if total:
        parts.append(f"coalesce(sum({col}), 0.0)::DOUBLE AS {total}")
    return ", ".join(parts)


def flow_cte(scope: str = "flow") -> str:
    """All flow columns in plain SQL, gaps in microseconds."""
    flow_window = f"PARTITION BY {KEY}" if scope == "flow" else "PARTITION BY capture_id"
    flag = lambda m: f"CASE WHEN proto = 6 AND (tcp_flags & {m}) <> 0 THEN 1 ELSE 0 END"
    div = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
    nf, nb = "count(*) FILTER (fwd)", "count(*) FILTER (NOT fwd)"
    bf, bb = "coalesce(sum(fl), 0)", "coalesce(sum(bl), 0)"
    sec = "((max(us) - min(us)) / 1e6)"
    big = lambda e, n: f"({e})::BIGINT AS {n}"
    cols = [
        "capture_id", "lo_ip || ':' || lo_port || '-' || hi_ip || ':' || hi_port AS flow_id",
        "lo_ip AS source_ip", "lo_port AS source_port", "hi_ip AS destination_ip", "hi_port AS destination_port",
        "proto AS protocol", big("min(us)", "start_us"), big("max(us) - min(us)", "flow_duration"),
        big(nf, "total_fwd_packets"), big(nb, "total_backward_packets"),
        big(bf, "total_length_of_fwd_packets"), big(bb, "total_length_of_bwd_packets"),
        _stat("fl", "fwd_packet_length"), _stat("bl", "bwd_packet_length"),
        f"{div(f'{bf} + {bb}', sec)} AS flow_bytes_s", f"{div('count(*)', sec)} AS flow_packets_s",
        _stat("flow_iat", "flow_iat"), _stat("fwd_iat", "fwd_iat", "fwd_iat_total"),
        _stat("bwd_iat", "bwd_iat", "bwd_iat_total"),
        big(f"sum(CASE WHEN fwd THEN {flag(8)} ELSE 0 END)", "fwd_psh_flags"),
        big(f"sum(CASE WHEN fwd THEN 0 ELSE {flag(8)} END)", "bwd_psh_flags"),
        big(f"sum(CASE WHEN fwd THEN {flag(32)} ELSE 0 END)", "fwd_urg_flags"),
        big(f"sum(CASE WHEN fwd THEN 0 ELSE {flag(32)} END)", "bwd_urg_flags"),
        big("coalesce(sum(hdr_len) FILTER (fwd), 0)", "fwd_header_length"),
        big("coalesce(sum(hdr_len) FILTER (NOT fwd), 0)", "bwd_header_length"),
        f"{div(nf, sec)} AS fwd_packets_s", f"{div(nb, sec)} AS bwd_packets_s",
        "min(pkt_len)::DOUBLE AS min_packet_length", "max(pkt_len)::DOUBLE AS max_packet_length",
        "avg(pkt_len) AS packet_length_mean", "stddev_pop(pkt_len) AS packet_length_std",
        "var_pop(pkt_len) AS packet_length_variance",
        *[big(f"sum({flag(m)})", f"{n}_flag_count") for n, m in
          (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("cwe", 128), ("ece", 64))],
        f"{div(nb, nf)} AS down_up_ratio", f"{div(f'{bf} + {bb}', 'count(*)')} AS average_packet_size",
        f"{div(bf, nf)} AS avg_fwd_segment_size", f"{div(bb, nb)} AS avg_bwd_segment_size",
        big("coalesce(sum(hdr_len) FILTER (fwd), 0)", "fwd_header_length_1"),
        *[f"0 AS {s}_{n}" for s in ("fwd", "bwd") for n in ("avg_bytes_bulk", "avg_packets_bulk", "avg_bulk_rate")],
        big(nf, "subflow_fwd_packets"), big(bf, "subflow_fwd_bytes"),
        big(nb, "subflow_bwd_packets"), big(bb, "subflow_bwd_bytes"),
        big("coalesce(max(tcp_win) FILTER (fwd AND proto = 6 AND dir_no = 1), 0)", "init_win_bytes_forward"),
        big("coalesce(max(tcp_win) FILTER (NOT fwd AND proto = 6 AND dir_no = 1), 0)", "init_win_bytes_backward"),
        big("count(*) FILTER (fwd AND proto = 6 AND pkt_len > hdr_len)", "act_data_pkt_fwd"),
        big("coalesce(min(pkt_len - hdr_len) FILTER (fwd AND proto = 6), 0)", "min_seg_size_forward"),
        *[big("max(us) - min(us)", f"active_{s}") for s in ("mean", "max", "min")], "0 AS active_std",
        *[f"0 AS idle_{s}" for s in ("mean", "std", "max", "min")], "0 AS simillar_http",
        "CASE WHEN hi_ip LIKE '192.168.%' OR hi_ip LIKE '172.16.%' OR hi_ip LIKE '10.%' THEN 1 ELSE 0 END AS inbound",
        "'BENIGN' AS label",
    ]
    return f"""{oracle_cte("packets")},
keyed AS (SELECT *, epoch_us(ts) AS us, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port < dst_port)) AS fwd FROM packets),
ends AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS lo_port,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS hi_port,
  CASE WHEN fwd THEN pkt_len END AS fl, CASE WHEN NOT fwd THEN pkt_len END AS bl FROM keyed),
gaps AS (SELECT *, us - lag(us) OVER ({flow_window} ORDER BY us, pkt_no) AS flow_iat,
  CASE WHEN fwd THEN us - lag(us) OVER (PARTITION BY {KEY}, fwd ORDER BY us, pkt_no) END AS fwd_iat,
  CASE WHEN NOT fwd THEN us - lag(us) OVER (PARTITION BY {KEY}, fwd ORDER BY us, pkt_no) END AS bwd_iat,
  row_number() OVER (PARTITION BY {KEY}, fwd ORDER BY us, pkt_no) AS dir_no FROM ends),
flows AS (SELECT {', '.join(cols)} FROM gaps GROUP BY {KEY})
"""


ID = ["capture_id", "flow_id", "protocol"]
GROUPS = {
    "flow_key": ("FLW0, FLW16", ["source_ip", "source_port", "destination_ip", "destination_port"]),
    "flow_duration": ("FLW1", ["start_us", "flow_duration"]),
    "flow_volume": ("FLW2", [
        "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets",
        "subflow_fwd_packets", "subflow_fwd_bytes", "subflow_bwd_packets", "subflow_bwd_bytes"]),
    "flow_direction_lengths": ("FLW3", [
        f"{d}_packet_length_{s}" for d in ("fwd", "bwd") for s in ("max", "min", "mean", "std")]),
    "flow_lengths": ("FLW4", [
        "min_packet_length", "max_packet_length", "packet_length_mean", "packet_length_std", "packet_length_variance"]),
    "flow_rates": ("FLW5", ["flow_bytes_s", "flow_packets_s", "fwd_packets_s", "bwd_packets_s"]),
    "flow_iat": ("FLW6, WIN1", [f"flow_iat_{s}" for s in ("mean", "std", "max", "min")]),
    "flow_direction_iat": ("FLW7", [
        f"{d}_iat_{s}" for d in ("fwd", "bwd") for s in ("total", "mean", "std", "max", "min")]),
    "flow_direction_flags": ("FLW8", ["fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags"]),
    "flow_flag_counts": ("FLW9", [
        f"{n}_flag_count" for n in ("fin", "syn", "rst", "psh", "ack", "urg", "cwe", "ece")]),
    "flow_header_lengths": ("FLW10", ["fwd_header_length", "bwd_header_length", "fwd_header_length_1"]),
    "flow_ratios": ("FLW11", [
        "down_up_ratio", "average_packet_size", "avg_fwd_segment_size", "avg_bwd_segment_size"]),
    "flow_init_window": ("FLW12, WIN7", ["init_win_bytes_forward", "init_win_bytes_backward"]),
    "flow_active_data": ("FLW13", ["act_data_pkt_fwd", "min_seg_size_forward"]),
    "flow_active_idle": ("FLW14", [
        "active_mean", "active_std", "active_max", "active_min", "idle_mean", "idle_std", "idle_max", "idle_min"]),
    "flow_bulk": ("FLW15", [
        "fwd_avg_bytes_bulk", "fwd_avg_packets_bulk", "fwd_avg_bulk_rate",
        "bwd_avg_bytes_bulk", "bwd_avg_packets_bulk", "bwd_avg_bulk_rate", "simillar_http"]),
    "flow_labels": ("FLW16, PRJ19, PRJ21", ["inbound", "label"]),
}
ORDERED = {"flow_iat", "flow_direction_iat", "flow_init_window"}
ALL = [c for c in FLOW_COLUMNS if c != "timestamp"] + ["start_us"]
REAL = {c for _, cols in GROUPS.values() for c in cols if c.split("_")[-1] in ("mean", "std", "max", "min", "s", "ratio",
        "size", "variance", "length", "total") and not c.startswith(("active", "idle"))}
REAL -= {"fwd_header_length", "bwd_header_length"}


def shown_sql(col: str) -> str:
    if "_iat_" in col:  # seconds: microsecond deviations exceed double precision when rounded
        return f"round({col} / 1e6, 3) AS {col}"
    return f"round({col}, 4) AS {col}" if col in REAL else col


def shown(df, cols):
    df = df.withColumn("start_us", F.unix_micros("timestamp"))
    return df.selectExpr(*[shown_sql(c) for c in cols])


def _group_query(name, cols):
    def run(spark, sf_dir):
        packets = adapter(spark, sf_dir, "packets")
        flows = build_flows(packets) if name in ORDERED else flow_totals(packets)
        return shown(flows, ID + cols)

    run.__doc__ = f"{GROUPS[name][0]}: one column group of the flow record."
    return run


for _name, (_ids, _cols) in GROUPS.items():
    query(_name, f"{flow_cte()} SELECT {', '.join(shown_sql(c) for c in ID + _cols)} FROM flows")(
        _group_query(_name, _cols)
    )


@query("flow_build", f"{flow_cte()} SELECT {', '.join(shown_sql(c) for c in ALL)} FROM flows")
def flow_build(spark, sf_dir):
    """FLW0-16: complete flow records."""
    return shown(build_flows(adapter(spark, sf_dir, "packets")), ALL)


IAT_COLS = ID + GROUPS["flow_iat"][1]


@query(
    "flow_capture_by_load",
    f"{flow_cte('capture')} SELECT {', '.join(shown_sql(c) for c in ALL)} FROM flows",
)
def flow_capture_by_load(spark, sf_dir):
    """FLW0-16 with capture scope, each capture cut into slices of a hundred seconds, fuller ones by their load."""
    packets = adapter(spark, sf_dir, "packets")
    return shown(build_flows(packets, "capture", slice_us=100_000_000, slice_rows=100_000), ALL)


@query(
    "flow_iat_capture",
    f"{flow_cte('capture')} SELECT {', '.join(shown_sql(c) for c in IAT_COLS)} FROM flows",
)
def flow_iat_capture(spark, sf_dir):
    """FLW6 with capture scope (Q3): gaps to the previous packet of the capture."""
    return shown(build_flows(adapter(spark, sf_dir, "packets"), iat_scope="capture"), IAT_COLS)


@query(
    "inter_arrival",
    f"""{flow_cte()} SELECT capture_id, pkt_no, fwd AS is_fwd, flow_iat::BIGINT AS flow_iat_us FROM gaps""",
)
def inter_arrival(spark, sf_dir):
    """WIN1: gap of every packet to the previous one of its flow."""
    keyed = with_flow_key(adapter(spark, sf_dir, "packets"))
    keys = ["capture_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
    lagged = lag_in_groups(keyed, keys, "ts_us", ["pkt_no"], "prev")
    return lagged.selectExpr("capture_id", "pkt_no", "is_fwd", "ts_us - prev AS flow_iat_us")


DAY = 86400
RATES = "round(pkt_rate, 6) AS pkt_rate, round(syn_rate, 6) AS syn_rate, round(udp_rate, 6) AS udp_rate, " \
        "round(dns_rate, 6) AS dns_rate, round(ntp_rate, 6) AS ntp_rate, round(avg_pkt_size, 6) AS avg_pkt_size"


def rate_sql(ts: str, w: int, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}(floor(epoch({ts}) / {w}) * {w})::BIGINT AS window_start_s,
  count(*) / {w}.0 AS pkt_rate, coalesce(sum(syn_flag_count), 0) / {w}.0 AS syn_rate,
  count(*) FILTER (protocol = 17) * 60 / {w}.0 AS udp_rate,
  count(*) FILTER (src_port = 53 OR dst_port = 53) / {w}.0 AS dns_rate,
  count(*) FILTER (src_port = 123 OR dst_port = 123) * 60 / {w}.0 AS ntp_rate,
  coalesce(avg(packet_length_mean), 0.0) AS avg_pkt_size"""


def _window_start(df):
    return df.withColumn("window_start_s", F.unix_seconds("window_start")).drop("window_start", "window_seconds")


@query(
    "window_features",
    f"{oracle_cte('cic_rows')}, f AS ({rate_sql('flow_ts', DAY)} FROM cic_rows GROUP BY ALL) "
    f"SELECT window_start_s, {RATES} FROM f",
)
def window_features(spark, sf_dir):
    """FEA1: standard rates per tumbling window."""
    return rounded(_window_start(extract_features(adapter(spark, sf_dir, "cic_rows"), "standard", DAY)))


@query(
    "full_features",
    f"{oracle_cte('cic_rows')} SELECT dst_port, src_port, protocol, syn_flag_count, "
    "round(packet_length_mean, 6) AS packet_length_mean, flow_duration, round(flow_packets_s, 6) AS flow_packets_s "
    "FROM cic_rows",
)
def full_features(spark, sf_dir):
    """FEA2: every numeric column except identifiers and the label."""
    return rounded(extract_features(adapter(spark, sf_dir, "cic_rows"), "full", exclude=["row_id"]))


MEANS = ["dst_port", "src_port", "protocol", "syn_flag_count", "packet_length_mean", "flow_duration", "flow_packets_s"]


@query(
    "hybrid_features",
    f"{oracle_cte('cic_rows')}, f AS ({rate_sql('flow_ts', DAY)}, "
    + ", ".join(f"avg({c}) AS {c}_mean" for c in MEANS)
    + f" FROM cic_rows GROUP BY ALL) SELECT window_start_s, {RATES}, "
    + ", ".join(f"round({c}_mean, 4) AS {c}_mean" for c in MEANS) + " FROM f",
)
def hybrid_features(spark, sf_dir):
    """FEA3: standard rates with the window mean of all numeric columns."""
    df = extract_features(adapter(spark, sf_dir, "cic_rows"), "hybrid", DAY, exclude=["row_id"])
    out = _window_start(df)
    return rounded(out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 4) for c in MEANS}))


@query(
    "labelled_features",
    f"{oracle_cte('cic_rows')}, named AS (SELECT *, CASE dst_port WHEN 53 THEN 'dns_' WHEN 123 THEN 'ntp_' "
    "WHEN 80 THEN 'Syn_' ELSE 'other_' END || source_file AS file FROM cic_rows), "
    f"f AS ({rate_sql('flow_ts', DAY * 30, 'file')} FROM named GROUP BY ALL), "
    "l AS (SELECT *, CASE WHEN lower(file) LIKE '%syn%' THEN 'syn_flood' WHEN lower(file) LIKE '%dns%' THEN 'dns_flood' "
    "WHEN lower(file) LIKE '%ntp%' THEN 'ntp_flood' ELSE 'normal' END AS label FROM f) "
    f"SELECT file, window_start_s, label, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS y, {RATES} FROM l",
)
def labelled_feature_set(spark, sf_dir):
    """FEA5, SNK6: features per file with the file's label and its dense code."""
    rows = adapter(spark, sf_dir, "cic_rows").selectExpr(
        "*", "concat(CASE dst_port WHEN 53 THEN 'dns_' WHEN 123 THEN 'ntp_' WHEN 80 THEN 'Syn_' ELSE 'other_' END, "
        "source_file) AS file",
    )
    feats, _ = labelled_features(rows, "file", DAY * 30)
    return rounded(_window_start(feats))


HOUR = 3600
TUNED = {"rule_thresholds": {"syn_flood_per_sec": 0.0005, "udp_flood_per_min": 0.05, "dns_flood_per_sec": 0.0005,
                             "ntp_flood_per_min": 0.02, "pkt_anomaly_per_sec": 0.001}}


@query(
    "window_verdict",
    f"""{flow_cte()}, named AS (SELECT to_timestamp(start_us / 1000000)::TIMESTAMP AS t, *,
  source_port AS src_port, destination_port AS dst_port FROM flows),
f AS ({rate_sql('t', HOUR)} FROM named GROUP BY ALL),
r AS (SELECT *, CASE WHEN syn_rate >= 0.001 THEN 2 WHEN syn_rate >= 0.0005 THEN 1 ELSE 0 END AS s,
  CASE WHEN udp_rate >= 0.1 THEN 2 WHEN udp_rate >= 0.05 THEN 1 ELSE 0 END AS u,
  CASE WHEN dns_rate >= 0.001 THEN 2 WHEN dns_rate >= 0.0005 THEN 1 ELSE 0 END AS d,
  CASE WHEN ntp_rate >= 0.04 THEN 2 WHEN ntp_rate >= 0.02 THEN 1 ELSE 0 END AS n,
  CASE WHEN pkt_rate > 0.001 AND avg_pkt_size < 100 THEN CASE WHEN pkt_rate >= 0.002 THEN 2 ELSE 1 END ELSE 0 END AS a FROM f),
v AS (SELECT *, (s > 0)::INT + (u > 0)::INT + (d > 0)::INT + (n > 0)::INT + (a > 0)::INT AS hits,
  greatest(s, u, d, n, a) AS top FROM r)
SELECT window_start_s, {RATES}, hits > 0 AS is_attack,
  CASE WHEN hits = 0 THEN 'NORMAL' WHEN s = top THEN 'SYN_FLOOD' WHEN u = top THEN 'UDP_FLOOD' WHEN d = top THEN 'DNS_FLOOD'
    WHEN n = top THEN 'NTP_FLOOD' ELSE 'ANOMALY' END AS attack_type,
  round(CASE WHEN hits = 0 THEN 0.0 ELSE least(1.0, 0.2 * hits + CASE WHEN top = 2 THEN 0.6 ELSE 0.45 END) END::DOUBLE, 6) AS confidence
FROM v""",
)
def window_verdict(spark, sf_dir):
    """FLW, FEA1, RUL1-7, FUS7: attack verdict per time window from packets."""
    out = window_verdicts(adapter(spark, sf_dir, "packets"), HOUR, TUNED)
    shown = out.select(
        F.unix_seconds("window_start").alias("window_start_s"), "pkt_rate", "syn_rate", "udp_rate", "dns_rate",
        "ntp_rate", "avg_pkt_size", "is_attack", F.col("prediction_label").alias("attack_type"), "confidence",
    )
    return rounded(shown)
