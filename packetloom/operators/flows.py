"""Packets to bidirectional flow records, in one pass over the packets.

Every flow is cut into time slices. One exchange on (flow key, slice) serves
the gap window and the aggregate of a slice, which holds mergeable integer
moments; the slices of a flow are then stitched at their borders and merged.
No flow is too large for its tasks, none takes another path, and the slice
width does not change a result. The earlier packet of the same direction is a
running "last value" over the same ordering as the flow-wide lag, so a single
sort is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.operators.skew import SLICE_US, sliced
from packetloom.session import ensure_checkpoint_dir

FLOW_KEY = ["capture_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
IAT = ["flow_iat", "fwd_iat", "bwd_iat"]
LENGTHS = ["fwd_len", "bwd_len", "all_len"]

# Output order of a flow record.
FLOW_COLUMNS = [
    "capture_id", "flow_id", "source_ip", "source_port", "destination_ip", "destination_port",
    "protocol", "timestamp", "flow_duration", "total_fwd_packets", "total_backward_packets",
    "total_length_of_fwd_packets", "total_length_of_bwd_packets",
    "fwd_packet_length_max", "fwd_packet_length_min", "fwd_packet_length_mean", "fwd_packet_length_std",
    "bwd_packet_length_max", "bwd_packet_length_min", "bwd_packet_length_mean", "bwd_packet_length_std",
    "flow_bytes_s", "flow_packets_s",
    "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min",
    "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
    "bwd_iat_total", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
    "fwd_header_length", "bwd_header_length", "fwd_packets_s", "bwd_packets_s",
    "min_packet_length", "max_packet_length", "packet_length_mean", "packet_length_std",
    "packet_length_variance",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count", "ack_flag_count",
    "urg_flag_count", "cwe_flag_count", "ece_flag_count", "down_up_ratio",
    "average_packet_size", "avg_fwd_segment_size", "avg_bwd_segment_size", "fwd_header_length_1",
    "fwd_avg_bytes_bulk", "fwd_avg_packets_bulk", "fwd_avg_bulk_rate",
    "bwd_avg_bytes_bulk", "bwd_avg_packets_bulk", "bwd_avg_bulk_rate",
    "subflow_fwd_packets", "subflow_fwd_bytes", "subflow_bwd_packets", "subflow_bwd_bytes",
    "init_win_bytes_forward", "init_win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "active_mean", "active_std", "active_max", "active_min",
    "idle_mean", "idle_std", "idle_max", "idle_min",
    "simillar_http", "inbound", "label",
]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """FLW0: canonical endpoints (text order, then port) and direction."""
    directed = packets.selectExpr(
        "*", "unix_micros(ts) AS ts_us", "src_ip < dst_ip OR (src_ip = dst_ip AND src_port < dst_port) AS is_fwd"
    )
    return directed.selectExpr(
        "*",
        "if(is_fwd, src_ip, dst_ip) AS lo_ip",
        "if(is_fwd, src_port, dst_port) AS lo_port",
        "if(is_fwd, dst_ip, src_ip) AS hi_ip",
        "if(is_fwd, dst_port, src_port) AS hi_port",
    )


def flow_measures(keyed: DataFrame) -> DataFrame:
    """Direction-masked measures, so that every aggregate stays a flat column."""
    flag = lambda name: f"(proto = 6 AND (tcp_flags & {K.TCP_FLAGS[name]}) != 0)"
    fwd_payload = "is_fwd AND proto = 6"
    return keyed.selectExpr(
        "*",
        "if(is_fwd, cast(pkt_len AS BIGINT), NULL) AS fwd_len",
        "if(is_fwd, NULL, cast(pkt_len AS BIGINT)) AS bwd_len",
        "cast(pkt_len AS BIGINT) AS all_len",
        "if(is_fwd, hdr_len, 0) AS fwd_hdr",
        "if(is_fwd, 0, hdr_len) AS bwd_hdr",
        f"int(is_fwd AND {flag('psh')}) AS fwd_psh",
        f"int(NOT is_fwd AND {flag('psh')}) AS bwd_psh",
        f"int(is_fwd AND {flag('urg')}) AS fwd_urg",
        f"int(NOT is_fwd AND {flag('urg')}) AS bwd_urg",
        f"int({fwd_payload} AND pkt_len > hdr_len) AS fwd_act",
        f"if({fwd_payload}, cast(pkt_len - hdr_len AS BIGINT), NULL) AS fwd_seg",
        *[f"int{flag(name)} AS {name}_n" for name in K.TCP_FLAGS],
    )


SUMS = ["fwd_hdr", "bwd_hdr", "fwd_psh", "bwd_psh", "fwd_urg", "bwd_urg", "fwd_act"] + [
    f"{name}_n" for name in K.TCP_FLAGS
]


def _with_gaps(rows: DataFrame, group: list[str], own_flow_iat: bool = True) -> DataFrame:
    """Gaps to the earlier packet in the flow and in the direction, in microseconds.

    ``fwd_win`` / ``bwd_win`` keep the window size of the first packet per
    direction only. Packets of one flow share the protocol, so the first
    packet of a direction is its first TCP packet.
    """
    over = f"PARTITION BY {', '.join(group)} ORDER BY ts_us, pkt_no"
    before = f"({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lagged = [f"lag(ts_us) OVER ({over}) AS prev_any"] if own_flow_iat else []
    return rows.selectExpr(
        "*",
        f"last(if(is_fwd, ts_us, NULL), true) OVER {before} AS prev_fwd",
        f"last(if(is_fwd, NULL, ts_us), true) OVER {before} AS prev_bwd",
        *lagged,
    ).selectExpr(
        "*",
        "ts_us - prev_any AS flow_iat",
        "if(is_fwd, ts_us - prev_fwd, NULL) AS fwd_iat",
        "if(is_fwd, NULL, ts_us - prev_bwd) AS bwd_iat",
        "if(is_fwd AND proto = 6 AND prev_fwd IS NULL, tcp_win, NULL) AS fwd_win",
        "if(NOT is_fwd AND proto = 6 AND prev_bwd IS NULL, tcp_win, NULL) AS bwd_win",
    )


def _exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def _partial(name: str) -> list[str]:
    """Mergeable exact moments of an integer measure."""
    d = f"cast({name} AS DECIMAL(19,0))"
    return [
        f"count({name}) AS {name}_c",
        f"sum({name}) AS {name}_sum",
        f"max({name}) AS {name}_max",
        f"min({name}) AS {name}_min",
        f"sum(cast({d} * {d} AS DECIMAL(28,0))) AS {name}_sq",
    ]


def _merge(name: str) -> list[str]:
    return [
        f"sum({name}_c) AS {name}_c",
        f"sum({name}_sum) AS {name}_sum",
        f"max({name}_max) AS {name}_max",
        f"min({name}_min) AS {name}_min",
        f"sum({name}_sq) AS {name}_sq",
    ]


def _moments(name: str) -> list[str]:
    """Mean and population deviation from exact integer sums (no cancellation).

    Sums beyond the decimal range, such as gaps of a year, fall back to doubles.
    """
    n, s1, s2 = f"{name}_c", f"{name}_sum", f"{name}_sq"
    wide = f"try_cast({s1} AS DECIMAL(19,0))"
    exact = f"double(try_cast({n} AS DECIMAL(12,0)) * try_cast({s2} AS DECIMAL(26,0)) - {wide} * {wide})"
    spread = f"coalesce({exact}, double({n}) * double({s2}) - double({s1}) * double({s1}))"
    return [
        f"try_divide(double({s1}), double({n})) AS {name}_mean",
        f"sqrt(greatest(try_divide({spread}, double({n}) * double({n})), 0D)) AS {name}_std",
    ]


COMMON = ["min(ts_us) AS first_us", "max(ts_us) AS last_us", "min(fwd_seg) AS fwd_seg"] + [
    f"sum({c}) AS {c}" for c in SUMS
]


def _slices(rows: DataFrame, own_flow_iat: bool) -> DataFrame:
    """One row per flow and slice: mergeable moments and what the borders need."""
    if not own_flow_iat:
        rows = rows.selectExpr("*", "lag(ts_us) OVER (PARTITION BY capture_id, __slice ORDER BY ts_us, pkt_no) AS prev_any")
    group = [*FLOW_KEY, "__slice"]
    return _with_gaps(rows, group, own_flow_iat).groupBy(*group).agg(
        *_exprs(
            *COMMON,
            *[c for name in LENGTHS + IAT for c in _partial(name)],
            "max(fwd_win) AS fwd_win",
            "max(bwd_win) AS bwd_win",
            "min(if(is_fwd, ts_us, NULL)) AS fwd_first",
            "max(if(is_fwd, ts_us, NULL)) AS fwd_last",
            "min(if(is_fwd, NULL, ts_us)) AS bwd_first",
            "max(if(is_fwd, NULL, ts_us)) AS bwd_last",
            "min(struct(ts_us, pkt_no)) AS first_place",
        )
    )


def _capture_gaps(slices: DataFrame) -> DataFrame:
    """Adds the gap from the last packet of the capture's earlier slice to the packet that opens a slice.

    One row per capture and slice; the flow that holds the opening packet gets the gap. The slices
    serve both sides of the join and are pinned, so that the packets are read once.
    """
    ensure_checkpoint_dir(slices.sparkSession)
    slices = slices.checkpoint()
    ends = slices.groupBy("capture_id", "__slice").agg(
        F.min("first_place").alias("__opens"), F.max("last_us").alias("__closes")
    )
    ends = ends.selectExpr(
        "capture_id", "__slice", "__opens", "lag(__closes) OVER (PARTITION BY capture_id ORDER BY __slice) AS __before"
    )
    return slices.join(ends, ["capture_id", "__slice"]).selectExpr(
        *slices.columns, "if(first_place = __opens, __opens.ts_us - __before, NULL) AS flow_iat_gap"
    )


def _stitched(slices: DataFrame, own_flow_iat: bool) -> DataFrame:
    """One row per flow: the gaps across slice borders join the moments of the slices."""
    before = (
        f"(PARTITION BY {', '.join(FLOW_KEY)} ORDER BY __slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    borders = {"fwd_iat": ("fwd_first", "fwd_last"), "bwd_iat": ("bwd_first", "bwd_last")}
    if own_flow_iat:
        borders["flow_iat"] = ("first_us", "last_us")
    else:
        slices = _capture_gaps(slices)
    slices = slices.selectExpr(
        "*", *[f"{first} - last({last}, true) OVER {before} AS {name}_gap" for name, (first, last) in borders.items()]
    )
    patched = []
    for name in IAT:
        gap = f"{name}_gap"
        wide = f"cast({gap} AS DECIMAL(19,0))"
        patched += [
            f"{name}_c + int({gap} IS NOT NULL) AS {name}_c",
            f"coalesce({name}_sum, 0) + coalesce({gap}, 0) AS {name}_sum",
            f"greatest({name}_max, {gap}) AS {name}_max",
            f"least({name}_min, {gap}) AS {name}_min",
            f"cast(coalesce({name}_sq, 0) + coalesce({wide} * {wide}, 0) AS DECIMAL(38,0)) AS {name}_sq",
        ]
    kept = [c for c in slices.columns if not any(c.startswith(f"{name}_") for name in IAT)]
    merged = slices.selectExpr(*kept, *patched).groupBy(*FLOW_KEY).agg(
        *_exprs(
            "min(first_us) AS first_us",
            "max(last_us) AS last_us",
            "min(fwd_seg) AS fwd_seg",
            *[f"sum({c}) AS {c}" for c in SUMS],
            *[c for name in LENGTHS + IAT for c in _merge(name)],
            "min_by(fwd_win, if(fwd_first IS NULL, NULL, __slice)) AS fwd_win",
            "min_by(bwd_win, if(bwd_first IS NULL, NULL, __slice)) AS bwd_win",
        )
    )
    return merged


def flow_records(merged: DataFrame) -> DataFrame:
    """FLW1-16 from one row of merged sums and moments per flow."""
    return _records(merged.selectExpr("*", *[c for name in LENGTHS + IAT for c in _moments(name)]))


def _records(agg: DataFrame) -> DataFrame:
    """FLW1-16: named output columns from the aggregates."""
    ratio = lambda a, b: f"coalesce(try_divide(double({a}), double({b})), 0D)"
    real = lambda name: f"coalesce(double({name}), 0D)"
    whole = lambda name: f"coalesce(cast({name} AS BIGINT), 0L)"
    duration, seconds = "(last_us - first_us)", "((last_us - first_us) / 1e6D)"
    nf, nb = "fwd_len_c", "bwd_len_c"
    bf, bb = whole("fwd_len_sum"), whole("bwd_len_sum")
    out = {
        "flow_id": "concat(lo_ip, ':', lo_port, '-', hi_ip, ':', hi_port)",
        "source_ip": "lo_ip",
        "source_port": "lo_port",
        "destination_ip": "hi_ip",
        "destination_port": "hi_port",
        "protocol": "proto",
        "timestamp": "timestamp_micros(first_us)",
        "flow_duration": duration,
        "total_fwd_packets": nf,
        "total_backward_packets": nb,
        "total_length_of_fwd_packets": bf,
        "total_length_of_bwd_packets": bb,
        "flow_bytes_s": ratio(f"({bf} + {bb})", seconds),
        "flow_packets_s": ratio(f"({nf} + {nb})", seconds),
        "fwd_packets_s": ratio(nf, seconds),
        "bwd_packets_s": ratio(nb, seconds),
        "min_packet_length": real("all_len_min"),
        "max_packet_length": real("all_len_max"),
        "packet_length_mean": real("all_len_mean"),
        "packet_length_std": real("all_len_std"),
        "packet_length_variance": f"{real('all_len_std')} * {real('all_len_std')}",
        "fwd_psh_flags": "fwd_psh",
        "bwd_psh_flags": "bwd_psh",
        "fwd_urg_flags": "fwd_urg",
        "bwd_urg_flags": "bwd_urg",
        "fwd_header_length": "fwd_hdr",
        "bwd_header_length": "bwd_hdr",
        "fwd_header_length_1": "fwd_hdr",
        "down_up_ratio": ratio(nb, nf),
        "average_packet_size": ratio(f"({bf} + {bb})", f"({nf} + {nb})"),
        "avg_fwd_segment_size": ratio(bf, nf),
        "avg_bwd_segment_size": ratio(bb, nb),
        "subflow_fwd_packets": nf,
        "subflow_fwd_bytes": bf,
        "subflow_bwd_packets": nb,
        "subflow_bwd_bytes": bb,
        "init_win_bytes_forward": whole("fwd_win"),
        "init_win_bytes_backward": whole("bwd_win"),
        "act_data_pkt_fwd": "fwd_act",
        "min_seg_size_forward": whole("fwd_seg"),
        "active_mean": duration,
        "active_max": duration,
        "active_min": duration,
        "inbound": r"int(hi_ip rlike '^(192\\.168\\.|172\\.16\\.|10\\.)')",
        "label": "'BENIGN'",
    }
    for side in ("fwd", "bwd"):
        for stat in ("max", "min", "mean", "std"):
            out[f"{side}_packet_length_{stat}"] = real(f"{side}_len_{stat}")
            out[f"{side}_iat_{stat}"] = real(f"{side}_iat_{stat}")
        out[f"{side}_iat_total"] = real(f"{side}_iat_sum")
        for name in ("avg_bytes_bulk", "avg_packets_bulk", "avg_bulk_rate"):
            out[f"{side}_{name}"] = "0"
    for stat in ("max", "min", "mean", "std"):
        out[f"flow_iat_{stat}"] = real(f"flow_iat_{stat}")
    for name in K.TCP_FLAGS:
        out[f"{name}_flag_count"] = f"{name}_n"
    for name in ("active_std", "idle_mean", "idle_std", "idle_max", "idle_min", "simillar_http"):
        out[name] = "0"
    return agg.selectExpr("capture_id", *[f"{out[c]} AS {c}" for c in FLOW_COLUMNS[1:]])


def build_flows(
    packets: DataFrame, iat_scope: str = "flow", slice_us: int = SLICE_US, slice_rows: int | None = None
) -> DataFrame:
    """FLW0-16: one record per capture, endpoint pair and protocol.

    ``iat_scope="capture"`` measures the flow-wide gaps against the previous
    packet of the whole capture. ``slice_us`` sets the time one task sorts at
    once; results do not depend on it.

    ``slice_rows`` bounds the packets of a slice too, for floods and captures
    with bursts: the packets per slice are counted first, from the keys and
    times alone, and fuller slices are cut by their load. Without it packets
    are read once.
    """
    if iat_scope not in ("flow", "capture"):
        raise ValueError(f"unknown iat_scope: {iat_scope}")
    own = iat_scope == "flow"
    keys = FLOW_KEY if own else ["capture_id"]
    keyed = sliced(with_flow_key(packets), keys, "ts_us", slice_us, slice_rows, "pkt_no")
    return flow_records(_stitched(_slices(flow_measures(keyed), own), own))


def flow_totals(packets: DataFrame) -> DataFrame:
    """FLW0-5, 8-11, 13-16 only: everything that needs no packet order.

    No window and no sort; the map-side combine makes it immune to hot flows.
    """
    rows = flow_measures(with_flow_key(packets))
    agg = rows.groupBy(*FLOW_KEY).agg(*_exprs(*COMMON, *[c for name in LENGTHS for c in _partial(name)]))
    absent = [f"{name}_{s}" for name in IAT for s in ("c", "sum", "max", "min", "mean", "std")]
    agg = agg.selectExpr(
        "*", *[c for name in LENGTHS for c in _moments(name)],
        *[f"cast(NULL AS BIGINT) AS {c}" for c in [*absent, "fwd_win", "bwd_win"]],
    )
    ordered = {c for c in FLOW_COLUMNS if "_iat_" in c or c.startswith("init_win")}
    return _records(agg).select(*[c for c in FLOW_COLUMNS if c not in ordered])
