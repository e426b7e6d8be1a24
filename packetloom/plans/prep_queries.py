"""Cleaning, preparation and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.labels import (
    event_severity,
    file_stem,
    is_attack_label,
    label_from_filename,
    normalize_attack_type,
    normalize_label,
)
from packetloom.functions.metrics import dynamic_metrics_from_map, normalize_key
from packetloom.functions.numeric import coerce_float_map, compact_map, finite, parse_double, safe_div, sanitize
from packetloom.operators import prep, sampling
from packetloom.operators.records import features_from_array, with_row_errors
from packetloom.plans.registry import query, rounded
from packetloom.sources.adapters import adapter, oracle_cte, table
from packetloom.sources.files import decode_csv_messages, with_source_file

CIC = oracle_cte("cic_rows")
RAW = "flow_bytes_s_raw"
# Every column: row_id alone repeats, and equal rows are interchangeable.
CIC_KEYS = ["row_id", "source_file", "flow_ts", "dst_port", "src_port", "protocol", "syn_flag_count",
            "packet_length_mean", "flow_duration", RAW, "flow_packets_s", "label"]


@query("clean_columns", f"{CIC} SELECT row_id, flow_packets_s AS \"Flow Packets/s\", label AS \"Label\" FROM cic_rows")
def clean_columns(spark, sf_dir):
    """PRJ1: trimmed headers."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr("row_id", "flow_packets_s AS ` Flow Packets/s`", "label AS `Label `")
    return prep.clean_columns(df)


@query(
    "null_inf",
    f"{CIC} SELECT row_id, CASE WHEN isinf(try_cast({RAW} AS DOUBLE)) THEN NULL ELSE try_cast({RAW} AS DOUBLE) END AS v FROM cic_rows",
)
def null_inf(spark, sf_dir):
    """PRJ2, PRJ6: text to double, infinity to null."""
    df = adapter(spark, sf_dir, "cic_rows").select("row_id", parse_double(F.col(RAW)).alias("v"))
    return prep.null_inf(df)


@query("feature_frame", f"{CIC} SELECT * EXCLUDE (label, flow_ts) FROM cic_rows")
def feature_frame(spark, sf_dir):
    """PRJ3: label and unnamed columns dropped."""
    df = adapter(spark, sf_dir, "cic_rows").drop("flow_ts").withColumn("Unnamed: 0", F.lit(1))
    return prep.feature_frame(df, "label")


KIND_INPUT = ["flow_time", "dst_port", RAW, "packet_length_mean", "source_file", "mixed"]
KIND_SQL = f"""{CIC}, t AS (SELECT strftime(flow_ts, '%Y-%m-%d %H:%M:%S') AS flow_time, dst_port::VARCHAR AS dst_port,
  nullif({RAW}, '') AS {RAW}, packet_length_mean::VARCHAR AS packet_length_mean, source_file,
  CASE WHEN protocol = 6 THEN src_port::VARCHAR ELSE 'udp' END AS mixed FROM cic_rows)"""
KIND_TEXT = ["date_format(flow_ts, 'yyyy-MM-dd HH:mm:ss') AS flow_time", "string(dst_port) AS dst_port",
             f"nullif({RAW}, '') AS {RAW}", "string(packet_length_mean) AS packet_length_mean", "source_file",
             "if(protocol = 6, string(src_port), 'udp') AS mixed"]


@query(
    "column_kinds",
    KIND_SQL + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, count({c}) AS non_null, "
        f"count(try_cast({c} AS DOUBLE)) AS numeric, {'count(try_cast(flow_time AS TIMESTAMP))' if 'time' in c else '0'} AS parsed, "
        f"CASE WHEN {'true' if 'time' in c else 'false'} THEN 'datetime' WHEN count({c}) = count(try_cast({c} AS DOUBLE)) THEN 'numeric' ELSE 'categorical' END AS kind FROM t"
        for i, c in enumerate(KIND_INPUT)
    ),
)
def column_kinds(spark, sf_dir):
    """PRJ4: kind of every column in one pass."""
    return prep.profile_columns(adapter(spark, sf_dir, "cic_rows").selectExpr(*KIND_TEXT))


@query(
    "fit_profile",
    KIND_SQL + """, m(c, o, kind, v) AS (
 SELECT 'flow_time', 0, 'datetime', median(epoch_us(flow_time::TIMESTAMP) * 1000.0) FROM t UNION ALL
 SELECT 'dst_port', 1, 'numeric', median(dst_port::DOUBLE) FROM t UNION ALL
 SELECT 'flow_bytes_s_raw', 2, 'numeric', median(x) FROM (SELECT try_cast(flow_bytes_s_raw AS DOUBLE) AS x FROM t) WHERE NOT isinf(x) UNION ALL
 SELECT 'packet_length_mean', 3, 'numeric', median(packet_length_mean::DOUBLE) FROM t UNION ALL
 SELECT 'source_file', 4, 'categorical', median(k) FROM (SELECT dense_rank() OVER (ORDER BY source_file) - 1.0 AS k FROM t) UNION ALL
 SELECT 'mixed', 5, 'categorical', median(k) FROM (SELECT dense_rank() OVER (ORDER BY mixed) - 1.0 AS k FROM t))
SELECT c AS "column", o AS ordinal, kind, round(v / 1000, 3)::DOUBLE AS fill_thousandth FROM m""",
)
def fit_profile(spark, sf_dir):
    """PRJ4-6, ML1, ML2: fitted kinds and median fills."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr(*KIND_TEXT)
    out = prep.fit_profile(df).to_df(spark)
    return out.selectExpr("column", "ordinal", "kind", "round(fill_value / 1000, 3) AS fill_thousandth")


@query("epoch_ns", f"{CIC} SELECT row_id, epoch_us(flow_ts) * 1000.0::DOUBLE AS ns FROM cic_rows")
def epoch_ns(spark, sf_dir):
    """PRJ5: timestamp text to epoch nanoseconds."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr("row_id", "date_format(flow_ts, 'yyyy-MM-dd HH:mm:ss') AS t")
    return df.select("row_id", prep.epoch_ns(F.col("t")).alias("ns"))


ALIGN = ["flow_packets_s", "absent", RAW]


@query("align", f"{CIC} SELECT flow_packets_s, NULL::VARCHAR AS absent, {RAW} FROM cic_rows")
def align(spark, sf_dir):
    """PRJ7: fitted order, missing column null, others dropped."""
    profile = prep.Profile(ALIGN, {c: "numeric" for c in ALIGN})
    return prep.align(adapter(spark, sf_dir, "cic_rows"), profile)


@query(
    "align_scorer",
    f"{CIC}, x AS (SELECT *, try_cast({RAW} AS DOUBLE) AS v FROM cic_rows) SELECT flow_packets_s, 0.0::DOUBLE AS absent, "
    f"CASE WHEN v IS NULL OR isinf(v) THEN 0.0 ELSE v END::DOUBLE AS {RAW} FROM x",
)
def align_scorer(spark, sf_dir):
    """PRJ8: scorer alignment, gaps and infinities are 0."""
    profile = prep.Profile(ALIGN, {c: "numeric" for c in ALIGN})
    return prep.align(adapter(spark, sf_dir, "cic_rows"), profile, fill=0.0)


@query(
    "numeric_prefix",
    f"{CIC} SELECT row_id::DOUBLE AS row_id, dst_port::DOUBLE AS dst_port, src_port::DOUBLE AS src_port, protocol::DOUBLE AS protocol, "
    "syn_flag_count::DOUBLE AS syn_flag_count, coalesce(packet_length_mean, 0.0)::DOUBLE AS packet_length_mean FROM cic_rows",
)
def numeric_prefix(spark, sf_dir):
    """PRJ8 without fitted names: the first n numeric columns."""
    return prep.numeric_prefix(adapter(spark, sf_dir, "cic_rows"), 6)


@query(
    "sanitize",
    f"{CIC}, x AS (SELECT row_id, try_cast({RAW} AS DOUBLE) * CASE WHEN protocol = 6 THEN 1 ELSE -1e9 END AS v FROM cic_rows) "
    "SELECT row_id, least(greatest(coalesce(v, 0.0), -1e12), 1e12)::DOUBLE AS v FROM x",
)
def sanitize_query(spark, sf_dir):
    """PRJ9: gaps to 0, clipped to +-1e12."""
    v = parse_double(F.col(RAW)) * F.when(F.col("protocol") == 6, 1.0).otherwise(-1e9)
    return adapter(spark, sf_dir, "cic_rows").select("row_id", sanitize(v).alias("v"))


# Records as maps of text, with odd spellings, blanks and bad numbers.
RECORD = """map_from_arrays(
  array('Protocol', ' SYN Flag Count', 'Flow Duration', 'Flow Packets/s', 'Packet Length Mean', 'note'),
  array(string(protocol), string(syn_flag_count), if(row_id % 3 = 0, NULL, string(flow_duration)),
        if(row_id % 5 = 0, 'n/a', if(row_id % 7 = 0, '1e309', string(flow_packets_s))),
        if(row_id % 4 = 0, '', string(packet_length_mean)), concat('x', label)))"""


def _records(spark, sf_dir):
    return adapter(spark, sf_dir, "cic_rows").selectExpr("*", f"{RECORD} AS record")


PPS = "CASE WHEN row_id % 5 = 0 OR row_id % 7 = 0 THEN NULL ELSE flow_packets_s END"
LEN = "CASE WHEN row_id % 4 = 0 THEN NULL ELSE packet_length_mean END"


RECORD_KEYS = {
    "protocol": "Protocol", "syn": " SYN Flag Count", "duration": "Flow Duration", "packets_s": "Flow Packets/s",
    "length": "Packet Length Mean", "note": "note",
}


def _fields(df, m):
    """The size and every field of a map column."""
    return df.select("row_id", F.size(m).alias("n"), *[F.col(m)[k].alias(name) for name, k in RECORD_KEYS.items()])


@query(
    "coerce_float_map",
    f"{CIC} SELECT row_id, 2 + (row_id % 3 <> 0)::INT + (row_id % 5 <> 0)::INT + (row_id % 4 <> 0 AND packet_length_mean IS NOT NULL)::INT AS n, "
    "protocol::DOUBLE AS protocol, syn_flag_count::DOUBLE AS syn, CASE WHEN row_id % 3 <> 0 THEN flow_duration::DOUBLE END AS duration, "
    "CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE flow_packets_s END AS packets_s, "
    "CASE WHEN row_id % 4 <> 0 THEN packet_length_mean END::DOUBLE AS length, NULL::DOUBLE AS note FROM cic_rows",
)
def coerce_map(spark, sf_dir):
    """PRJ10: numbers of a record only."""
    return _fields(_records(spark, sf_dir).select("row_id", coerce_float_map(F.col("record")).alias("m")), "m")


@query(
    "compact_map",
    f"{CIC} SELECT row_id, 4 + (row_id % 3 <> 0)::INT + (row_id % 4 <> 0 AND packet_length_mean IS NOT NULL)::INT AS n, "
    "protocol::VARCHAR AS protocol, syn_flag_count::VARCHAR AS syn, CASE WHEN row_id % 3 <> 0 THEN flow_duration::VARCHAR END AS duration, "
    "CASE WHEN row_id % 5 = 0 THEN 'n/a' WHEN row_id % 7 = 0 THEN '1e309' ELSE flow_packets_s::VARCHAR END AS packets_s, "
    "CASE WHEN row_id % 4 <> 0 THEN packet_length_mean::VARCHAR END AS length, 'x' || label AS note FROM cic_rows",
)
def compact(spark, sf_dir):
    """PRJ11: null and empty fields dropped."""
    return _fields(_records(spark, sf_dir).select("row_id", compact_map(F.col("record")).alias("m")), "m")


@query("normalize_key", f"{oracle_cte('payloads')} SELECT payload_id, regexp_replace(lower(payload), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS k FROM payloads")
def normalize_key_query(spark, sf_dir):
    """PRJ12: letters and digits only, lower case, over whole texts."""
    return adapter(spark, sf_dir, "payloads").select("payload_id", normalize_key(F.col("payload")).alias("k"))


@query(
    "finite_parse",
    f"{CIC} SELECT row_id, {PPS} AS v FROM cic_rows",
)
def finite_parse(spark, sf_dir):
    """PRJ13: finite numbers only."""
    return _records(spark, sf_dir).select("row_id", finite(F.col("record")["Flow Packets/s"]).alias("v"))


def _metric_sql(udp_factor: str) -> str:
    return f"""{CIC}, x AS (SELECT row_id, protocol, syn_flag_count AS syn, CASE WHEN row_id % 3 = 0 THEN NULL ELSE flow_duration END AS dur,
  {PPS} AS pps, {LEN} AS len FROM cic_rows),
y AS (SELECT *, greatest(0.0, CASE WHEN dur > 0 THEN syn / (dur / 1e6) WHEN pps IS NOT NULL THEN syn * pps ELSE syn END) AS s FROM x)
SELECT row_id, round(coalesce(len, 0.0), 6)::DOUBLE AS pkt_len,
  round(CASE WHEN s <= 0 AND protocol = 6 AND pps IS NOT NULL THEN pps ELSE s END, 6)::DOUBLE AS syn_count,
  round(CASE WHEN protocol = 17 AND pps IS NOT NULL THEN pps * {udp_factor} ELSE 0.0 END, 6)::DOUBLE AS udp_count FROM y"""


@query("dynamic_metrics", _metric_sql("1.0"))
def dynamic_metrics_query(spark, sf_dir):
    """PRJ14: packet length, SYN and UDP metrics of free-form records."""
    out = dynamic_metrics_from_map(_records(spark, sf_dir), "record")
    return rounded(out.select("row_id", "pkt_len", "syn_count", "udp_count"))


@query("dynamic_metrics_minute", _metric_sql("60.0"))
def dynamic_metrics_minute(spark, sf_dir):
    """PRJ14 with UDP scaled to a minute (Q14 option)."""
    out = dynamic_metrics_from_map(_records(spark, sf_dir), "record", udp_per_minute=True)
    return rounded(out.select("row_id", "pkt_len", "syn_count", "udp_count"))


SCORED = oracle_cte("scored")


@query(
    "normalize_label",
    f"{SCORED} SELECT y_true, nullif(upper(trim(y_true)), '') AS label, count(*) AS n FROM scored GROUP BY ALL",
)
def normalize_label_query(spark, sf_dir):
    """PRJ15: trimmed upper-case labels."""
    df = adapter(spark, sf_dir, "scored").select("y_true", normalize_label(F.col("y_true")).alias("label"))
    return df.groupBy("y_true", "label").agg(F.count(F.lit(1)).alias("n"))


DETECTIONS = oracle_cte("detections")
SEV = "CASE WHEN NOT atk THEN 'info' WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"


@query("is_attack_label", f"{DETECTIONS} SELECT event_uid, lower(trim(prediction_label)) NOT IN ('normal', 'benign', '0') AS is_attack FROM detections")
def is_attack_query(spark, sf_dir):
    """PRJ16: attack predicate."""
    df = adapter(spark, sf_dir, "detections")
    return df.select("event_uid", is_attack_label(F.col("prediction_label")).alias("is_attack"))


@query(
    "normalize_attack_type",
    f"{DETECTIONS}, x AS (SELECT event_uid, upper(trim(prediction_label || CASE WHEN source = 'api' THEN '_detection ' ELSE '' END)) AS t FROM detections) "
    "SELECT event_uid, replace(t, '_DETECTION', '') AS attack_type FROM x",
)
def attack_type_query(spark, sf_dir):
    """PRJ17: verdict names without detector suffix."""
    text = F.concat("prediction_label", F.when(F.col("source") == "api", "_detection ").otherwise(""))
    return adapter(spark, sf_dir, "detections").select("event_uid", normalize_attack_type(text).alias("attack_type"))


@query(
    "event_severity",
    f"{DETECTIONS}, x AS (SELECT *, lower(prediction_label) NOT IN ('normal', 'benign', '0') AS atk FROM detections) "
    f"SELECT event_uid, {SEV} AS severity FROM x",
)
def event_severity_query(spark, sf_dir):
    """PRJ18: event severity."""
    df = adapter(spark, sf_dir, "detections")
    attack = is_attack_label(F.col("prediction_label"))
    return df.select("event_uid", event_severity(F.col("confidence"), attack).alias("severity"))


@query("safe_div", f"{CIC} SELECT row_id, CASE WHEN syn_flag_count = 0 THEN 0.0 ELSE round(flow_duration::DOUBLE / syn_flag_count, 6) END::DOUBLE AS r FROM cic_rows")
def safe_div_query(spark, sf_dir):
    """PRJ20: division that yields 0 on a zero denominator."""
    return rounded(adapter(spark, sf_dir, "cic_rows").select("row_id", safe_div(F.col("flow_duration"), F.col("syn_flag_count")).alias("r")))


@query(
    "row_errors",
    f"{CIC}, x AS (SELECT row_id, CASE WHEN protocol = 6 THEN {RAW} ELSE label END AS {RAW}, flow_packets_s FROM cic_rows) "
    f"SELECT row_id, CASE WHEN {RAW} <> '' AND try_cast({RAW} AS DOUBLE) IS NULL THEN 'Invalid feature value: {RAW}=' || {RAW} END AS error FROM x",
)
def row_errors(spark, sf_dir):
    """PRJ23: bad rows carry their error."""
    df = adapter(spark, sf_dir, "cic_rows").withColumn(RAW, F.when(F.col("protocol") == 6, F.col(RAW)).otherwise(F.col("label")))
    return with_row_errors(df, [RAW, "flow_packets_s"]).select("row_id", "error")


@query(
    "features_array",
    f"{CIC} SELECT row_id, CASE WHEN protocol = 6 THEN 'Expected 3 raw features, got 2' END AS error, "
    "CASE WHEN protocol <> 6 THEN dst_port END::DOUBLE AS a, CASE WHEN protocol <> 6 THEN src_port END::DOUBLE AS b, "
    "CASE WHEN protocol <> 6 THEN coalesce(packet_length_mean, 0) END::DOUBLE AS c FROM cic_rows",
)
def features_array(spark, sf_dir):
    """PRJ24: fixed-length list input."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr(
        "row_id", "if(protocol = 6, array(double(dst_port), double(src_port)), array(double(dst_port), double(src_port), packet_length_mean)) AS f"
    )
    return features_from_array(df, "f", ["a", "b", "c"]).select("row_id", "error", "a", "b", "c")


@query(
    "category_codes",
    f"{CIC}, v AS (SELECT *, coalesce(CASE WHEN protocol = 6 THEN label END, '__missing__') AS kind FROM cic_rows), "
    "d AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS k FROM (SELECT DISTINCT kind FROM v WHERE kind <> 'LDAP')), "
    "f AS (SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS k FROM (SELECT DISTINCT source_file FROM v WHERE kind <> 'LDAP')) "
    "SELECT v.row_id, coalesce(d.k, -1)::DOUBLE AS kind, coalesce(f.k, -1)::DOUBLE AS source_file FROM v LEFT JOIN d USING (kind) LEFT JOIN f USING (source_file)",
)
def category_codes(spark, sf_dir):
    """ML1, JON2: alphabetical codes; a category unseen at fit is -1."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr("row_id", "source_file", "if(protocol = 6, label, NULL) AS kind")
    codes = prep.fit_categories(df.where("kind IS NULL OR kind <> 'LDAP'"), ["kind", "source_file"])
    return prep.apply_categories(df, codes, ["kind", "source_file"])


NUM = ["packet_length_mean", RAW, "flow_duration", "flow_packets_s"]
CLEAN = f"""c AS (SELECT row_id, packet_length_mean, CASE WHEN isinf(try_cast({RAW} AS DOUBLE)) THEN NULL ELSE try_cast({RAW} AS DOUBLE) END AS {RAW},
  flow_duration::DOUBLE AS flow_duration, flow_packets_s FROM cic_rows),
i AS (SELECT row_id, {', '.join(f'coalesce({x}, (SELECT median({x}) FROM c)) AS {x}' for x in NUM)} FROM c)"""


def _numeric(spark, sf_dir):
    df = adapter(spark, sf_dir, "cic_rows")
    return prep.null_inf(df.select("row_id", *[parse_double(F.col(c)).alias(c) for c in NUM]))


@query("impute_median", f"{CIC}, {CLEAN} SELECT row_id, {', '.join(f'round({x}, 6) AS {x}' for x in NUM)} FROM i")
def impute_median(spark, sf_dir):
    """ML2: exact medians in place of gaps."""
    df = _numeric(spark, sf_dir)
    return rounded(prep.apply_fill(df, prep.fit_medians(df, NUM)))


@query(
    "impute_scale",
    f"{CIC}, {CLEAN}, s AS (SELECT {', '.join(f'avg({x}) AS m{k}, stddev_pop({x}) AS d{k}' for k, x in enumerate(NUM))} FROM i) "
    f"SELECT row_id, {', '.join(f'round(({x} - m{k}) / d{k}, 6) AS {x}' for k, x in enumerate(NUM))} FROM i, s",
)
def impute_scale(spark, sf_dir):
    """ML2, ML4: median fill, then scaling with the population deviation."""
    df = _numeric(spark, sf_dir)
    filled = prep.apply_fill(df, prep.fit_medians(df, NUM))
    return rounded(prep.scale(filled, *prep.fit_scaler(filled, NUM)))


@query("label_encode", f"{CIC} SELECT row_id, label, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS y FROM cic_rows")
def label_encode(spark, sf_dir):
    """ML3: alphabetical dense label codes."""
    coded, _ = prep.encode_labels(adapter(spark, sf_dir, "cic_rows").select("row_id", "label"), "label", "y")
    return coded


@query(
    "stratified_split",
    """WITH c AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY event_type),
q AS (SELECT event_type, (n * ceil(t * 0.2)::BIGINT) // t::BIGINT AS base, (n * ceil(t * 0.2)::BIGINT) % t::BIGINT AS rest, ceil(t * 0.2)::BIGINT AS test FROM c),
k AS (SELECT event_type, base + (row_number() OVER (ORDER BY rest DESC, event_type) <= test - sum(base) OVER ())::INT AS want FROM q),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS rn FROM events)
SELECT event_id, event_type, rn <= want AS is_test FROM r JOIN k USING (event_type)""",
)
def stratified_split(spark, sf_dir):
    """ML5: exact stratified split in hash order."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_split(rows, "event_type", ["event_id"], 0.2, 42)


FEATS = ["dst_port", "src_port", "syn_flag_count", "flow_duration", "flow_packets_s"]
ANOVA = f"{CIC}, " + ", ".join(
    f"g{i} AS (SELECT '{x}' AS feature, {i} AS ordinal, label, count(*) AS n, sum({x}::DOUBLE) AS s, avg({x}) AS m, "
    f"var_pop({x}) * count(*) AS w FROM cic_rows GROUP BY label)" for i, x in enumerate(FEATS)
) + ", g AS (" + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(FEATS))) + """),
o AS (SELECT feature, sum(s) / sum(n) AS gm FROM g GROUP BY feature),
f AS (SELECT g.feature, ordinal, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f_score
  FROM g JOIN o ON g.feature = o.feature GROUP BY g.feature, ordinal)"""


def _scores(spark, sf_dir):
    return prep.anova_f(adapter(spark, sf_dir, "cic_rows"), FEATS, "label")


@query("anova_f", f"{ANOVA} SELECT feature, ordinal, round(f_score, 4) AS f_score FROM f")
def anova(spark, sf_dir):
    """ML6: one-way F per feature."""
    return rounded(_scores(spark, sf_dir), 4)


@query("select_k_best", f"{ANOVA} SELECT feature, ordinal FROM f ORDER BY f_score DESC, ordinal LIMIT 3")
def select_k_best(spark, sf_dir):
    """ML7, WIN6: the best features."""
    return prep.select_k_best(_scores(spark, sf_dir), 3).select("feature", "ordinal")


@query("label_distribution", f"{CIC} SELECT label, count(*) AS n FROM cic_rows GROUP BY label")
def label_distribution(spark, sf_dir):
    """ML8: rows per class, at least two classes."""
    df = adapter(spark, sf_dir, "cic_rows")
    prep.check_two_classes(df, "label")
    return prep.label_distribution(df, "label")


@query(
    "balanced_weights",
    f"{CIC}, c AS (SELECT label, count(*) AS n FROM cic_rows GROUP BY label) SELECT row_id, label, "
    "round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 6) AS weight FROM cic_rows JOIN c USING (label)",
)
def balanced_weights(spark, sf_dir):
    """ML12: class balancing weights."""
    return rounded(prep.balanced_weights(adapter(spark, sf_dir, "cic_rows").select("row_id", "label"), "label"))


def _hash_sql(seed: str) -> str:
    cols = ", ".join(f"coalesce({c}, '')" if c in ("source_file", RAW, "label") else c for c in SHOWN)
    return f"md5(concat_ws('|', '{seed}', {cols}))"


# Key text must agree between engines, so only integer and text columns key the order.
SHOWN = ["row_id", "source_file", "dst_port", "src_port", "protocol", "syn_flag_count", "flow_duration", RAW, "label"]
SHOWN_SQL = ", ".join(SHOWN)


def _rows(spark, sf_dir):
    return adapter(spark, sf_dir, "cic_rows").select(*SHOWN)


def _ranked(seed: str) -> str:
    return (f"{CIC}, h AS (SELECT {SHOWN_SQL}, {_hash_sql(seed)} AS h FROM cic_rows), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY h, {SHOWN_SQL}) AS rn FROM h), "
            "c AS (SELECT source_file, count(*) AS n, count(*) OVER () AS files FROM cic_rows GROUP BY source_file)")


@query(
    "cap_rows_per_file",
    f"{_ranked('0')} SELECT {SHOWN_SQL} FROM r WHERE rn <= 500 AND source_file IN (SELECT source_file FROM c ORDER BY source_file LIMIT 4)",
)
def cap_rows(spark, sf_dir):
    """SRC3: the first files, capped rows of each."""
    return sampling.cap_rows_per_file(_rows(spark, sf_dir), "source_file", SHOWN, 500, 4)


@query(
    "online_window",
    f"{_ranked('0')}, q AS (SELECT source_file, least(n, 2000) AS k, coalesce(sum(least(n, 2000)) OVER (ORDER BY source_file "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) "
    f"SELECT {SHOWN_SQL} FROM r JOIN q USING (source_file) WHERE rn <= least(k, greatest(0, 9000 - before))",
)
def online_window(spark, sf_dir):
    """ML17: training buffer over files in order."""
    return sampling.online_window(_rows(spark, sf_dir), "source_file", SHOWN, 9000, 2000)


@query(
    "online_window_shared",
    f"{_ranked('0')}, s AS (SELECT source_file, least(n, greatest(1000, 9000 // files)) AS k FROM c), "
    "q AS (SELECT *, coalesce(sum(k) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) "
    f"SELECT {SHOWN_SQL} FROM r JOIN q USING (source_file) WHERE rn <= least(k, greatest(0, 9000 - before))",
)
def online_window_shared(spark, sf_dir):
    """ML17 without a per-file cap: even shares."""
    return sampling.online_window(_rows(spark, sf_dir), "source_file", SHOWN, 9000)


@query(
    "balanced_quota",
    f"{_ranked('0')}, s AS (SELECT source_file, least(n, ceil(2000 / files)::BIGINT) AS k FROM c), "
    "q AS (SELECT *, coalesce(sum(k) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) "
    f"SELECT {SHOWN_SQL} FROM r JOIN q USING (source_file) WHERE rn <= least(k, greatest(0, 2000 - before))",
)
def balanced_quota(spark, sf_dir):
    """WIN4: even shares per file under a global cap."""
    return sampling.balanced_quota(_rows(spark, sf_dir), "source_file", SHOWN, 2000)


@query(
    "seeded_sample",
    f"{_ranked('42')}, s AS (SELECT source_file, least(n, 200) AS k FROM c), "
    "q AS (SELECT *, coalesce(sum(k) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), "
    f"p AS (SELECT {SHOWN_SQL} FROM r JOIN q USING (source_file) WHERE rn <= k AND before < 1000) "
    f"SELECT {SHOWN_SQL} FROM p ORDER BY {_hash_sql('42-global')}, {SHOWN_SQL} LIMIT 1000",
)
def seeded_sample(spark, sf_dir):
    """WIN5: seeded sample per file, global shuffle and cap."""
    return sampling.seeded_sample(_rows(spark, sf_dir), "source_file", SHOWN, 200, 1000, 42)


@query(
    "union_files",
    f"{CIC} SELECT row_id, label, flow_packets_s, NULL::BIGINT AS flow_duration FROM cic_rows WHERE protocol = 6 "
    "UNION ALL SELECT row_id, label, NULL, flow_duration FROM cic_rows WHERE protocol = 17",
)
def union_files(spark, sf_dir):
    """SET1: tables with differing columns."""
    df = adapter(spark, sf_dir, "cic_rows")
    tcp = df.where("protocol = 6").select("row_id", "label", "flow_packets_s")
    udp = df.where("protocol = 17").select("label", "row_id", "flow_duration")
    return prep.union_files([tcp, udp])


@query("source_file", "SELECT source_file, count(*) AS n FROM (SELECT 'lineitem.parquet' AS source_file FROM lineitem) GROUP BY 1")
def source_file(spark, sf_dir):
    """SRC4: rows tagged with their file."""
    rows = with_source_file(table(spark, sf_dir, "lineitem"))
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def _file_label_sql(style: str) -> str:
    if style == "flood":
        words, end = [("syn", "syn_flood"), ("udplag", "udplag_flood"), ("udp", "udp_flood"), ("ldap", "ldap_flood"),
                      ("mssql", "mssql_flood"), ("netbios", "netbios_flood"), ("portmap", "portmap_flood"),
                      ("dns", "dns_flood"), ("ntp", "ntp_flood")], "'normal'"
        name = "lower(f)"
    else:
        words, end = [("benign", "BENIGN"), ("normal", "BENIGN"), ("syn", "SYN"), ("udp", "UDP"), ("dns", "DNS"), ("ntp", "NTP"),
                      ("ldap", "LDAP"), ("mssql", "MSSQL"), ("netbios", "NetBIOS"), ("portmap", "Portmap")], "s"
        name = "lower(s)"
    return "CASE " + " ".join(f"WHEN contains({name}, '{w}') THEN '{v}'" for w, v in words) + f" ELSE {end} END"


FILES_SQL = ("SELECT row_id, CASE protocol WHEN 6 THEN label ELSE CASE syn_flag_count + dst_port WHEN 53 THEN 'UDPLag' ELSE 'capture' END END "
             "|| '_' || source_file AS f FROM cic_rows")


@query(
    "file_labels",
    f"{CIC}, x AS ({FILES_SQL}), y AS (SELECT *, regexp_replace(f, '\\.csv$', '') AS s FROM x) "
    f"SELECT row_id, f, {_file_label_sql('flood')} AS flood, {_file_label_sql('replay')} AS replay FROM y",
)
def file_labels(spark, sf_dir):
    """SRC7: labels hinted by file names, both vocabularies."""
    df = adapter(spark, sf_dir, "cic_rows").selectExpr(
        "row_id", "concat(CASE protocol WHEN 6 THEN label ELSE CASE syn_flag_count + dst_port WHEN 53 THEN 'UDPLag' ELSE 'capture' END END, "
        "'_', source_file) AS f"
    )
    return df.select("row_id", "f", label_from_filename(F.col("f")).alias("flood"), label_from_filename(F.col("f"), "replay").alias("replay"))


@query("file_stem", f"{CIC} SELECT source_file, regexp_replace(source_file, '\\.csv$', '') AS stem, count(*) AS n FROM cic_rows GROUP BY ALL")
def file_stem_query(spark, sf_dir):
    """SRC7: stem of a file path."""
    path = F.concat(F.lit("/data/raw/"), F.col("source_file"))
    df = adapter(spark, sf_dir, "cic_rows").select("source_file", file_stem(path).alias("stem"))
    return df.groupBy("source_file", "stem").agg(F.count(F.lit(1)).alias("n"))


@query("label_column", f"{CIC} SELECT label, count(*) AS n FROM cic_rows GROUP BY label")
def label_column(spark, sf_dir):
    """SRC8: label column found by candidate list."""
    df = adapter(spark, sf_dir, "cic_rows").withColumnRenamed("label", " Class ")
    name = prep.resolve_label_column(df.columns)
    return prep.label_distribution(df.withColumnRenamed(name, "label"), "label")


@query(
    "csv_envelope",
    "SELECT l_orderkey, l_linenumber, '/output/' || l_orderkey || '.csv' AS file_path, no AS line_no, "
    "CASE no WHEN 1 THEN l_partkey ELSE l_suppkey END::VARCHAR AS part, l_returnflag AS flag FROM lineitem, (VALUES (1), (2)) t(no) "
    "WHERE l_partkey % 7 <> 0 AND l_partkey % 11 <> 0",
)
def csv_envelope(spark, sf_dir):
    """SRC6: CSV rows out of message envelopes; malformed envelopes drop out."""
    messages = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        """concat(if(l_partkey % 7 = 0, 'CSV:', ' CSV_CONTENT:'), '/output/', l_orderkey, '.csv', if(l_partkey % 11 = 0, ' ', '\\n'),
           'part,flag', if(l_partkey % 11 = 0, ' ', '\\n'), l_partkey, ',', l_returnflag, if(l_partkey % 11 = 0, ' ', '\\r\\n'),
           l_suppkey, ',"', l_returnflag, '"') AS body""",
    )
    return decode_csv_messages(messages, "body", ["part", "flag"], ["l_orderkey", "l_linenumber"])
