"""Views of the driver tables in the shapes the operators take.

The same SQL text runs in Spark and in DuckDB, so every operator has real
input and an oracle over the very same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTER_SQL = {
    "packets": """
SELECT concat('cap', cast(user_id % 5 AS STRING)) AS capture_id, event_id AS pkt_no, cast(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_id % 3 = 0 THEN ip_s ELSE ip_c END AS src_ip,
       cast(CASE WHEN event_id % 3 = 0 THEN port_s ELSE port_c END AS INT) AS src_port,
       CASE WHEN event_id % 3 = 0 THEN ip_c ELSE ip_s END AS dst_ip,
       cast(CASE WHEN event_id % 3 = 0 THEN port_c ELSE port_s END AS INT) AS dst_port,
       proto, hdr_len,
       cast(hdr_len + CASE WHEN event_id % 8 = 0 THEN 0 ELSE floor(value) END AS INT) AS pkt_len,
       cast(CASE WHEN proto = 17 THEN 0 ELSE base_flags
            + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 32 ELSE 0 END
            + CASE WHEN event_id % 11 = 0 THEN 64 ELSE 0 END + CASE WHEN event_id % 13 = 0 THEN 128 ELSE 0 END END AS INT) AS tcp_flags,
       cast(CASE WHEN proto = 6 THEN 1024 + event_id % 5000 END AS INT) AS tcp_win
FROM (SELECT *,
        concat('10.0.', cast(user_id % 3 AS STRING), '.', cast(user_id % 7 AS STRING)) AS ip_c,
        40000 + user_id % 4 AS port_c,
        CASE WHEN user_id % 10 = 0 THEN concat('10.0.', cast(user_id % 3 AS STRING), '.', cast(user_id % 7 AS STRING))
             ELSE concat('192.168.1.', cast(event_id % 4 AS STRING)) END AS ip_s,
        CASE event_type WHEN 'view' THEN 53 WHEN 'purchase' THEN 123 WHEN 'signup' THEN 443 WHEN 'click' THEN 80 ELSE 22 END AS port_s,
        cast(CASE WHEN event_type IN ('view', 'purchase') THEN 17 ELSE 6 END AS INT) AS proto,
        cast(CASE WHEN event_type IN ('view', 'purchase') THEN 8 ELSE 20 END AS INT) AS hdr_len,
        CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 24 WHEN 'error' THEN 20 ELSE 0 END AS base_flags
      FROM {events}) e
""",
    "cic_rows": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       concat('part', cast(l_suppkey % 7 AS STRING), '.csv') AS source_file,
       cast(l_shipdate AS TIMESTAMP) AS flow_ts,
       cast(CASE l_linenumber % 4 WHEN 0 THEN 53 WHEN 1 THEN 123 WHEN 2 THEN 80 ELSE 443 END AS INT) AS dst_port,
       cast(1024 + l_partkey % 60000 AS INT) AS src_port,
       cast(CASE WHEN l_linenumber % 4 IN (0, 1) THEN 17 ELSE 6 END AS INT) AS protocol,
       cast(CASE WHEN l_linenumber % 4 IN (0, 1) THEN 0 ELSE floor(l_quantity) % 5 END AS INT) AS syn_flag_count,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * 20 END AS packet_length_mean,
       cast(floor(l_extendedprice) AS BIGINT) AS flow_duration,
       CASE WHEN l_partkey % 97 = 0 THEN 'Infinity' WHEN l_partkey % 89 = 0 THEN '' ELSE cast(cast(floor(l_extendedprice) AS BIGINT) AS STRING) END AS flow_bytes_s_raw,
       l_discount * 1000 AS flow_packets_s,
       CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'SYN'
            WHEN l_returnflag = 'A' THEN 'UDP' WHEN l_linestatus = 'O' THEN 'LDAP' ELSE 'MSSQL' END AS label
FROM {lineitem}
""",
    "rate_features": """
SELECT l_orderkey, l_linenumber, l_extendedprice / 4 AS pkt_rate, l_quantity * 22 AS syn_rate, l_extendedprice / 3 AS udp_rate,
       l_quantity * 90 AS dns_rate, l_extendedprice / 8 AS ntp_rate, l_quantity * 4 AS avg_pkt_size, 1 AS window_seconds,
       CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_linestatus = 'O' THEN 'SYN_FLOOD' ELSE 'LDAP' END AS ml_label,
       0.5 + l_discount * 4 AS ml_confidence
FROM {lineitem}
""",
    "payloads": """
SELECT concat('p', cast(page_id AS STRING)) AS payload_id, html AS payload FROM {pages}
UNION ALL
SELECT concat('d', cast(doc_id AS STRING)),
       CASE WHEN doc_id % 10 = 0 THEN concat('id=1 OR 1=1; DROP TABLE t-- ', text) WHEN doc_id % 10 = 1 THEN concat('select name ', text) ELSE text END FROM {documents}
UNION ALL
SELECT concat('c', cast(conv_id AS STRING), '_', cast(turn AS STRING)), CASE WHEN turn % 5 = 4 THEN NULL ELSE text END FROM {conversations}
""",
    "scored": """
SELECT concat('part', cast(l_suppkey % 7 AS STRING), '.csv') AS source_file,
       CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'SYN' ELSE ' udp ' END AS y_true,
       CASE WHEN l_partkey % 9 = 0 THEN 'LDAP' WHEN l_partkey % 5 = 0 THEN 'SYN'
            WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' THEN 'SYN' ELSE 'UDP' END AS y_pred,
       0.4 + l_discount * 5 AS confidence
FROM {lineitem}
""",
    "detections": """
SELECT substr(md5(cast(event_id AS STRING)), 1, 16) AS event_uid, cast(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'error' THEN 'SYN_FLOOD' WHEN 'purchase' THEN 'LDAP' WHEN 'signup' THEN 'Portmap' WHEN 'view' THEN 'BENIGN' ELSE 'normal' END AS prediction_label,
       value / 500.0 AS confidence,
       CASE event_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'replay' ELSE 'mixed_replay' END AS source,
       'record' AS input_kind,
       concat(cast(1 + user_id % 223 AS STRING), '.', cast(event_id % 256 AS STRING), '.0.', cast(user_id % 256 AS STRING)) AS client_ip,
       concat('tr-', cast(user_id AS STRING)) AS trace_id
FROM {events}
""",
    "scan_findings": """
SELECT concat('tr-', cast(s.s_suppkey % 150 AS STRING)) AS trace_id, concat('10.9.0.', cast(s.s_suppkey % 250 AS STRING)) AS target,
       cast(p.port AS INT) AS port, 'tcp' AS protocol,
       CASE (s.s_suppkey + p.port) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'error' ELSE 'closed' END AS state
FROM {supplier} s CROSS JOIN (SELECT 21 AS port UNION ALL SELECT 22 UNION ALL SELECT 80 UNION ALL SELECT 443 UNION ALL SELECT 445 UNION ALL SELECT 3306 UNION ALL SELECT 6379 UNION ALL SELECT 8080) p
""",
    "ip_ranges": """
SELECT cast(n_nationkey * 9 + 1 AS BIGINT) * 16777216 AS ip_lo, cast(n_nationkey * 9 + 7 AS BIGINT) * 16777216 - 1 AS ip_hi,
       n_name AS country, cast(n_regionkey AS INT) AS region_key
FROM {nation}
""",
    "manifest": """
SELECT 'part0.csv' AS file, 'BENIGN' AS label UNION ALL SELECT 'part1', 'SYN_FLOOD' UNION ALL SELECT '/data/raw/part2.csv', 'UDP_FLOOD'
""",
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter as a DataFrame over the tables of ``sf_dir``."""
    sql = ADAPTER_SQL[name]
    sources = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **sources)


def oracle_cte(*names: str) -> str:
    """The adapters as a WITH clause for a database where the tables are views."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', ADAPTER_SQL[n]).strip()})" for n in names]
    return "WITH " + ",\n".join(parts)
