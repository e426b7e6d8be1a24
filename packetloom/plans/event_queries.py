"""Event log, alert, enrichment and address queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.ip import client_ip, is_public_ip, normalize_ip
from packetloom.functions.text import event_uid
from packetloom.operators import enrich, events as log
from packetloom.operators.explain import classify_ports, scan_summary
from packetloom.operators.flows import flow_totals
from packetloom.plans.registry import query, rounded, sql_text
from packetloom.sources.adapters import adapter, oracle_cte

D = oracle_cte("detections") + """,
e0 AS (SELECT *, lower(trim(prediction_label)) NOT IN ('normal', 'benign', '0') AS is_attack, epoch_us(ts) AS us FROM detections),
e AS (SELECT *, CASE WHEN NOT is_attack THEN 'info' WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.8 THEN 'high'
  WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS severity, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM e0)"""


def _events(spark, sf_dir):
    return log.to_events(adapter(spark, sf_dir, "detections"))


@query(
    "event_counters",
    f"{D} SELECT 'label' AS kind, prediction_label AS key, count(*) AS n, count(*) FILTER (is_attack) AS attacks FROM e GROUP BY 2 "
    "UNION ALL SELECT 'source', source, count(*), count(*) FILTER (is_attack) FROM e GROUP BY 2 "
    "UNION ALL SELECT 'total', NULL, count(*), count(*) FILTER (is_attack) FROM e",
)
def event_counters(spark, sf_dir):
    """AGG2: counts per label, per source, overall."""
    return log.event_counters(_events(spark, sf_dir))


def _map_text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")


@query(
    "event_summary",
    f"""{D}, l AS (SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS labels FROM (SELECT prediction_label AS k, count(*) AS n FROM e GROUP BY 1)),
s AS (SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS sources FROM (SELECT source AS k, count(*) AS n FROM e GROUP BY 1)),
z AS (SELECT event_uid AS last_uid, us AS last_us FROM e ORDER BY us DESC, event_uid DESC LIMIT 1)
SELECT count(*) AS total_events, count(*) FILTER (is_attack) AS attack_events, count(*) FILTER (NOT is_attack) AS benign_events,
  round(avg(is_attack::INT), 6) AS attack_ratio, any_value(labels) AS labels, any_value(sources) AS sources, any_value(last_uid) AS last_uid,
  any_value(last_us) AS last_us FROM e, l, s, z""",
)
def event_summary(spark, sf_dir):
    """AGG1: one-row summary with maps and the last event."""
    out = log.event_summary(_events(spark, sf_dir))
    return rounded(out.select(
        "total_events", "attack_events", "benign_events", "attack_ratio", _map_text("labels").alias("labels"), _map_text("sources").alias("sources"),
        F.col("last_event.event_uid").alias("last_uid"), F.unix_micros("last_event.ts").alias("last_us"),
    ))


TOP = 5


def _top_sql(key):
    return (
        f"SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS shown, sum(n)::BIGINT AS n FROM "
        f"(SELECT {key} AS k, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, k LIMIT {TOP})"
    )


@query(
    "event_summary_top",
    f"""{D}, l AS ({_top_sql("prediction_label")}), s AS ({_top_sql("right(event_uid, 2)")}), t AS (SELECT count(*) AS total_events FROM e)
SELECT total_events, l.shown AS labels, s.shown AS sources, total_events - l.n AS other_label_events, total_events - s.n AS other_source_events FROM t, l, s""",
)
def event_summary_top(spark, sf_dir):
    """AGG1: the one-row summary with a bound on its maps, over sources as many as the ends of event ids."""
    out = log.event_summary(_events(spark, sf_dir).withColumn("source", F.expr("right(event_uid, 2)")), top=TOP)
    return out.select("total_events", _map_text("labels").alias("labels"), _map_text("sources").alias("sources"), "other_label_events", "other_source_events")


@query("event_recent", f"{D} SELECT event_uid, us, prediction_label, severity FROM e ORDER BY us DESC, event_uid DESC LIMIT 100")
def event_recent(spark, sf_dir):
    """WIN2: the newest events."""
    out = log.recent_events(_events(spark, sf_dir), 100)
    return out.select("event_uid", F.unix_micros("ts").alias("us"), "prediction_label", "severity")


CURSOR = "2024-01-15T00:00:00.000000+00:00|8"


@query(
    "event_delta",
    f"{D} SELECT event_uid, us, iso || '|' || event_uid AS \"cursor\" FROM e WHERE us > 1705276800000000 OR (us = 1705276800000000 AND event_uid > '8') ORDER BY us, event_uid LIMIT 200",
)
def event_delta(spark, sf_dir):
    """WIN3, STR7: oldest events after a cursor."""
    out = log.events_delta(_events(spark, sf_dir), CURSOR, 200)
    return out.select("event_uid", F.unix_micros("ts").alias("us"), "cursor")


@query(
    "event_delta_last",
    f"{D} SELECT event_uid, us FROM e WHERE us > 1705276800000000 OR (us = 1705276800000000 AND event_uid > '8') ORDER BY us DESC, event_uid DESC LIMIT 200",
)
def event_delta_last(spark, sf_dir):
    """WIN3 keeping the newest (Q17)."""
    return log.events_delta(_events(spark, sf_dir), CURSOR, 200, keep="last").select("event_uid", F.unix_micros("ts").alias("us"))


@query(
    "next_cursor",
    f"{D}, d AS (SELECT * FROM e WHERE us > 1705276800000000 OR (us = 1705276800000000 AND event_uid > '8') ORDER BY us, event_uid LIMIT 200) "
    "SELECT iso || '|' || event_uid AS \"cursor\" FROM d ORDER BY us DESC, event_uid DESC LIMIT 1",
)
def next_cursor(spark, sf_dir):
    """WIN3: cursor to continue from."""
    return log.next_cursor(log.events_delta(_events(spark, sf_dir), CURSOR, 200), CURSOR)


@query(
    "timeline",
    f"{D} SELECT iso AS timestamp, prediction_label, printf('%.6f', confidence) AS confidence, is_attack::INT AS is_attack, severity, source FROM e",
)
def timeline(spark, sf_dir):
    """SNK2: attack timeline rows."""
    return log.timeline(_events(spark, sf_dir))


@query(
    "batch_alerts",
    f"{D} SELECT source, count(*) AS total_events, count(*) FILTER (is_attack) AS attack_events, max(us) AS last_us, "
    "count(*) FILTER (NOT is_attack) AS benign_events, round(avg(is_attack::INT), 6) AS attack_ratio FROM e GROUP BY source HAVING count(*) FILTER (is_attack) > 0",
)
def batch_alerts(spark, sf_dir):
    """AGG12, STR8: alert roll-up per source."""
    out = log.batch_alerts(_events(spark, sf_dir)).withColumn("last_us", F.unix_micros("timestamp")).drop("timestamp")
    return rounded(out)


@query(
    "batch_messages",
    f"{D} SELECT source, printf('[批量告警]' || chr(10) || '时间: %s' || chr(10) || '总事件: %d' || chr(10) || '攻击事件: %d' || chr(10) || '正常事件: %d' || chr(10) || '攻击比例: %.2f%%' || chr(10), "
    "strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', count(*), count(*) FILTER (is_attack), count(*) FILTER (NOT is_attack), "
    "count(*) FILTER (is_attack) / count(*)::DOUBLE * 100) AS message FROM e GROUP BY source HAVING count(*) FILTER (is_attack) > 0",
)
def batch_messages(spark, sf_dir):
    """TXT4: batch alert text."""
    return log.batch_messages(log.batch_alerts(_events(spark, sf_dir))).select("source", "message")


@query(
    "alert_messages",
    f"{D} SELECT event_uid, printf('[安全告警]' || chr(10) || '时间: %s' || chr(10) || '攻击类型: %s' || chr(10) || '严重度: %s' || chr(10) || '置信度: %.4f' || chr(10) || '来源: %s' || chr(10) || '输入类型: %s' || chr(10) || '摘要: %s' || chr(10), "
    f"iso, prediction_label, severity, confidence, source, input_kind, {sql_text(K.DEFAULT_ALERT_SUMMARY)}) AS message FROM e WHERE is_attack",
)
def alert_messages(spark, sf_dir):
    """TXT4, TXT5: alert text per attack event."""
    return log.alert_messages(log.alert_context(_events(spark, sf_dir))).select("event_uid", "message")


@query(
    "alert_context",
    f"{D} SELECT event_uid, iso AS timestamp, prediction_label AS attack_type, severity, round(confidence, 6) AS confidence, source, input_kind, "
    f"{sql_text(K.DEFAULT_ALERT_SUMMARY)} AS summary FROM e WHERE is_attack",
)
def alert_context(spark, sf_dir):
    """TXT5, JON7: alert context of attack events."""
    return rounded(log.alert_context(_events(spark, sf_dir)))


@query("event_uid", "SELECT event_id, substr(md5(event_id || '|' || user_id), 1, 16) AS event_uid FROM events")
def event_uid_query(spark, sf_dir):
    """TXT6: event ids derived from the event key."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", event_uid(F.col("event_id"), F.col("user_id")).alias("event_uid"))


@query(
    "replay_tally",
    oracle_cte("scored") + """, x AS (SELECT y_pred AS p, y_true AS g, source_file AS f, y_pred <> 'BENIGN' AS a FROM scored)
SELECT 'predicted' AS kind, p AS key, count(*) AS n, count(*) FILTER (a) AS attacks FROM x GROUP BY p UNION ALL
SELECT 'input', g, count(*), count(*) FILTER (a) FROM x GROUP BY g UNION ALL SELECT 'file', f, count(*), count(*) FILTER (a) FROM x GROUP BY f UNION ALL
SELECT 'total', NULL, count(*), count(*) FILTER (a) FROM x""",
)
def replay_tally(spark, sf_dir):
    """AGG13: totals by predicted label, input label and file."""
    df = adapter(spark, sf_dir, "scored").withColumn("a", F.col("y_pred") != "BENIGN")
    return log.tally(df, "y_pred", "y_true", "source_file", "a")


@query(
    "attack_flows",
    f"{D}, p AS (SELECT user_id, event_id, value FROM events), k AS (SELECT DISTINCT client_ip FROM e WHERE is_attack) "
    "SELECT event_uid, client_ip FROM e WHERE client_ip IN (SELECT client_ip FROM k)",
)
def attack_flows(spark, sf_dir):
    """JON7: rows of clients with at least one attack event."""
    rows = _events(spark, sf_dir)
    return log.with_any_attack(rows.select("event_uid", "client_ip"), rows, "client_ip").select("event_uid", "client_ip")


@query(
    "manifest_labels",
    oracle_cte("cic_rows", "manifest") + """, f AS (SELECT row_id, '/data/raw/' || source_file AS path, source_file AS name, replace(source_file, '.csv', '') AS stem FROM cic_rows)
SELECT row_id, path, coalesce(a.label, b.label, c.label, 'BENIGN') AS label FROM f LEFT JOIN manifest a ON a.file = name LEFT JOIN manifest b ON b.file = stem LEFT JOIN manifest c ON c.file = path""",
)
def manifest_labels(spark, sf_dir):
    """JON1: file labels by name, stem or path."""
    rows = adapter(spark, sf_dir, "cic_rows").selectExpr("row_id", "concat('/data/raw/', source_file) AS path")
    return enrich.manifest_labels(rows, "path", adapter(spark, sf_dir, "manifest"))


NUM = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"
HIDDEN = " OR ".join(
    f"n BETWEEN {lo} AND {hi}" for lo, hi in (
        (0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183),
        (2886729728, 2887778303), (3221225472, 3221225479), (3221225642, 3221225643), (3221225984, 3221226239), (3232235520, 3232301055),
        (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295))
)
GEO = oracle_cte("detections", "ip_ranges") + f""", a AS (SELECT event_uid, client_ip, {NUM.format('client_ip')} AS n FROM detections),
h AS (SELECT *, ({HIDDEN}) AS hidden FROM a),
g AS (SELECT h.*, r.country, r.region_key, r.ip_lo FROM h LEFT JOIN ip_ranges r ON NOT hidden AND n BETWEEN r.ip_lo AND r.ip_hi)"""


@query(
    "geo_range_join",
    f"{GEO} SELECT event_uid, client_ip AS geo_ip, country, region_key, ip_lo IS NOT NULL AS geo_resolved, "
    "CASE WHEN hidden THEN 'non_public_ip' WHEN ip_lo IS NULL THEN 'not_found' END AS geo_reason FROM g",
)
def geo_range_join(spark, sf_dir):
    """JON4, TXT3: range lookup of client addresses."""
    events = adapter(spark, sf_dir, "detections").select("event_uid", "client_ip")
    out = enrich.geo_enrich(events, "client_ip", adapter(spark, sf_dir, "ip_ranges"), ["country", "region_key"])
    return out.select("event_uid", "geo_ip", "country", "region_key", "geo_resolved", "geo_reason")


@query("public_ip", f"{GEO} SELECT event_uid, NOT hidden AS is_public FROM h")
def public_ip(spark, sf_dir):
    """TXT3: public address test."""
    return adapter(spark, sf_dir, "detections").select("event_uid", is_public_ip(F.col("client_ip")).alias("is_public"))


SPELLED = """CASE event_id % 7 WHEN 0 THEN concat('"', ip, '"') WHEN 1 THEN concat(ip, ':8080') WHEN 2 THEN concat('  ', ip, ' ')
 WHEN 3 THEN 'unknown' WHEN 4 THEN concat(ip, '%eth0') WHEN 5 THEN concat(ip, '.7') ELSE ip END"""
IP = "concat(cast(1 + user_id % 223 AS STRING), '.', cast(event_id % 256 AS STRING), '.0.', cast(user_id % 256 AS STRING))"


@query(
    "normalize_ip",
    f"WITH x AS (SELECT event_id, {IP} AS ip FROM events) SELECT event_id, CASE WHEN event_id % 7 IN (3, 5) THEN NULL ELSE ip END AS ip FROM x",
)
def normalize_ip_query(spark, sf_dir):
    """TXT1: address text in many spellings."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{IP} AS ip")
    return df.selectExpr("event_id", f"{SPELLED} AS raw").select("event_id", normalize_ip(F.col("raw")).alias("ip"))


V6 = """concat('2001:0DB8:', lower(hex(user_id % 3)), ':0:0:', CASE event_id % 3 WHEN 0 THEN '0' ELSE lower(hex(event_id % 65536)) END, ':0:', upper(hex(user_id % 2)))"""


@query(
    "normalize_ip_v6",
    """WITH x AS (SELECT event_id, user_id % 3 AS c, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 65536 END AS f, user_id % 2 AS h FROM events)
SELECT event_id, CASE WHEN f = 0 AND c = 0 AND h = 0 THEN '2001:db8::' WHEN f = 0 AND c = 0 THEN '2001:db8::1'
  WHEN f = 0 AND h = 0 THEN '2001:db8:' || c || '::' WHEN f = 0 THEN '2001:db8:' || c || '::1'
  WHEN c = 0 THEN '2001:db8::' || printf('%x', f) || ':0:' || h ELSE '2001:db8:' || c || '::' || printf('%x', f) || ':0:' || h END AS ip FROM x""",
)
def normalize_ip_v6(spark, sf_dir):
    """TXT1: canonical IPv6 text."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{V6} AS raw")
    return df.select("event_id", normalize_ip(F.col("raw")).alias("ip"))


@query(
    "client_ip",
    f"""WITH x AS (SELECT event_id, {IP} AS ip, user_id % 256 AS u FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN ip WHEN 1 THEN ip WHEN 2 THEN ip WHEN 3 THEN '10.1.0.' || u ELSE '127.0.0.1' END AS client_ip FROM x""",
)
def client_ip_query(spark, sf_dir):
    """TXT2: client address from header maps, host as fallback."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{IP} AS ip", "user_id % 256 AS u")
    headers = df.selectExpr(
        "event_id",
        """CASE event_id % 5 WHEN 0 THEN map('X-Forwarded-For', concat('unknown, ', ip, ', 10.0.0.3'), 'X-Real-IP', '1.1.1.1')
           WHEN 1 THEN map('Forwarded', concat('proto=http; FOR="', ip, ':99";by=203.0.113.43'))
           WHEN 2 THEN map('CF-Connecting-IP', ip, 'X-Forwarded-For', '9.9.9.9')
           WHEN 3 THEN map('True-Client-Ip', 'none', 'X-Client-IP', concat('10.1.0.', u))
           ELSE map('Accept', 'text/html') END AS headers""",
    )
    return headers.select("event_id", client_ip(F.col("headers"), F.lit("127.0.0.1")).alias("client_ip"))


HUB = oracle_cte("detections", "scan_findings") + """,
s AS (SELECT trace_id, make_timestamp(1704067200000000 + substr(trace_id, 4)::BIGINT * 14400000000) AS scan_ts, count(*) AS total_probes,
  count(*) FILTER (state = 'open') AS open_port_count FROM scan_findings GROUP BY trace_id)"""


def _scans(spark, sf_dir):
    summary = scan_summary(classify_ports(adapter(spark, sf_dir, "scan_findings")), ["trace_id"])
    return summary.selectExpr(
        "trace_id", "timestamp_micros(1704067200000000 + bigint(substr(trace_id, 4)) * 14400000000) AS scan_ts", "total_probes", "open_port_count"
    )


@query(
    "hub_interval_join",
    f"{HUB} SELECT event_uid, d.trace_id, d.source, epoch_us(scan_ts) AS scan_us, total_probes, open_port_count FROM detections d JOIN s "
    "ON d.trace_id = s.trace_id AND abs(epoch_us(ts) - epoch_us(scan_ts)) <= 172800000000",
)
def hub_interval_join(spark, sf_dir):
    """JON3: detections and scans of a trace within two days."""
    detections = adapter(spark, sf_dir, "detections").select("event_uid", "trace_id", "source", "ts")
    out = enrich.merge_with_scans(detections, _scans(spark, sf_dir), 172800)
    return out.select("event_uid", "trace_id", "source", F.unix_micros("scan_ts").alias("scan_us"), "total_probes", "open_port_count")


KINDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}
# A third of the scans has no detection near it, and many detections no scan.
KIND_SQL = " UNION ALL ".join(
    f"SELECT '{how}' AS kind, event_uid, coalesce(d.trace_id, t.trace_id) AS trace_id, epoch_us(ts) AS us, epoch_us(scan_ts) AS scan_us, "
    f"total_probes FROM detections d {join} t ON d.trace_id = t.trace_id AND abs(epoch_us(ts) - epoch_us(scan_ts)) <= 172800000000"
    for how, join in KINDS.items()
)


def moved_scans(spark, sf_dir):
    return _scans(spark, sf_dir).withColumn("scan_ts", F.expr("scan_ts + IF(bigint(substr(trace_id, 4)) % 3 = 0, INTERVAL 900 DAYS, INTERVAL 0 DAYS)"))


MOVED = "t AS (SELECT s.* REPLACE (CASE WHEN substr(trace_id, 4)::BIGINT % 3 = 0 THEN scan_ts + INTERVAL 900 DAYS ELSE scan_ts END AS scan_ts) FROM s)"


@query("hub_join_kinds", f"{HUB}, {MOVED} {KIND_SQL}")
def hub_join_kinds(spark, sf_dir):
    """JON3 with every kind of join."""
    detections = adapter(spark, sf_dir, "detections").select("event_uid", "trace_id", "ts")
    scans = moved_scans(spark, sf_dir).select("trace_id", "scan_ts", "total_probes")
    parts = [enrich.merge_with_scans(detections, scans, 172800, how).select(F.lit(how).alias("kind"), "*") for how in KINDS]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select(
        "kind", "event_uid", "trace_id", F.unix_micros("ts").alias("us"), F.unix_micros("scan_ts").alias("scan_us"), "total_probes"
    )


# Nested and overlapping ranges: regions of several nations, nations, suppliers inside nations; and IPv4 ones.
RANGES_V6 = """
SELECT printf('2a00:%04x:0000:0000:0000:0000:0000:0000', n_nationkey * 4) AS ip_lo, printf('2a00:%04x:ffff:ffff:ffff:ffff:ffff:ffff', n_nationkey * 4 + 1) AS ip_hi,
  n_name AS owner, 1 AS tier FROM {nation}
UNION ALL SELECT printf('2a00:%04x:0000:0000:0000:0000:0000:0000', r_regionkey * 20), printf('2a00:%04x:7fff:ffff:ffff:ffff:ffff:ffff', r_regionkey * 20 + 27), r_name, 2 FROM {region}
UNION ALL SELECT printf('2a00:%04x:%04x:0000:0000:0000:0000:0000', s_nationkey * 4, s_suppkey), printf('2a00:%04x:%04x:00ff:ffff:ffff:ffff:fffd', s_nationkey * 4, s_suppkey), s_name, 0 FROM {supplier}
"""
ADDRESS_V6 = "printf('2a00:%04x:%04x:%04x:0000:0000:0000:%04x', user_id % 130, event_id % 120, event_id % 300, 65530 + event_id % 6)"


@query(
    "geo_range_join_v6",
    f"WITH r AS ({RANGES_V6.replace('{', '').replace('}', '')}), a AS (SELECT event_id, {ADDRESS_V6} AS ip FROM events), "
    "h AS (SELECT event_id, owner, row_number() OVER (PARTITION BY event_id ORDER BY tier, ip_lo) AS n FROM a JOIN r ON replace(ip, ':', '') "
    "BETWEEN replace(ip_lo, ':', '') AND replace(ip_hi, ':', '')) SELECT a.event_id, owner, owner IS NOT NULL AS geo_resolved, "
    "CASE WHEN owner IS NULL THEN 'not_found' END AS geo_reason FROM a LEFT JOIN h ON a.event_id = h.event_id AND n = 1",
)
def geo_range_join_v6(spark, sf_dir):
    """JON4: IPv6 look-up in nested and overlapping ranges, the narrowest one counts."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "supplier")}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{ADDRESS_V6} AS ip")
    out = enrich.geo_enrich_any(events, "ip", spark.sql(RANGES_V6, **tables), ["owner"])
    return out.select("event_id", "owner", "geo_resolved", "geo_reason")


@query(
    "unprocessed_files",
    oracle_cte("cic_rows", "manifest") + " SELECT DISTINCT source_file AS path FROM cic_rows WHERE source_file NOT IN (SELECT file FROM manifest)",
)
def unprocessed_files(spark, sf_dir):
    """JON6: files not processed yet."""
    files = adapter(spark, sf_dir, "cic_rows").selectExpr("source_file AS path").distinct()
    return enrich.unprocessed(files, adapter(spark, sf_dir, "manifest").selectExpr("file AS path"))
