from __future__ import annotations

import pytest

from packetloom.operators import skew
from packetloom.operators.flows import FLOW_COLUMNS, FLOW_KEY, build_flows, flow_totals, with_flow_key
from packetloom.sources.adapters import adapter


def rows(df):
    key = ["capture_id", "flow_id", "protocol"]
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("scope", ["flow", "capture"])
def test_sliced_flows_equal_whole_flows(spark, sf_dir, scope):
    """The same records, to the last digit, from one slice, the usual ones and a slice per second."""
    packets = adapter(spark, sf_dir, "packets")
    whole = rows(build_flows(packets, scope, slice_us=10**17))
    assert whole == rows(build_flows(packets, scope)) == rows(build_flows(packets, scope, slice_us=10**6))


@pytest.mark.parametrize("scope", ["flow", "capture"])
def test_packets_are_read_once(spark, tmp_path, sf_dir, scope):
    """The running tasks read each packet row once."""
    adapter(spark, sf_dir, "packets").coalesce(1).write.parquet(str(tmp_path / "p"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    packets = spark.read.parquet(str(tmp_path / "p"))
    build_flows(packets.mapInArrow(count, packets.schema), scope).write.format("noop").mode("overwrite").save()
    assert seen.value == packets.count()


def test_one_hot_flow_is_stitched(spark):
    """One flow with all packets, several sharing a timestamp."""
    packets = spark.range(5000).selectExpr(
        "'c' AS capture_id", "id AS pkt_no", "timestamp_micros(1700000000000000 + (id div 3) * (1 + id % 7) * 1000) AS ts",
        "if(id % 4 = 0, '10.0.0.1', '10.0.0.2') AS src_ip", "if(id % 4 = 0, 80, 5000) AS src_port",
        "if(id % 4 = 0, '10.0.0.2', '10.0.0.1') AS dst_ip", "if(id % 4 = 0, 5000, 80) AS dst_port",
        "6 AS proto", "20 AS hdr_len", "int(20 + id % 100) AS pkt_len", "2 AS tcp_flags", "int(id % 9999) AS tcp_win",
    )
    whole = build_flows(packets, slice_us=10**17).first().asDict()
    cut = build_flows(packets, slice_us=50_000).first().asDict()
    for column in FLOW_COLUMNS:
        assert cut[column] == whole[column], column


def test_totals_equal_full_records(spark, sf_dir):
    packets = adapter(spark, sf_dir, "packets")
    full, totals = rows(build_flows(packets)), rows(flow_totals(packets))
    for key, row in totals.items():
        for column, value in row.items():
            assert value == full[key][column]


def test_fixed_quirks(spark):
    """Three packets: duration and gaps follow time, direction follows endpoint text."""
    packets = spark.createDataFrame(
        [
            (1, 0, "b", 9, "a", 7, 100, 2, 500),
            (2, 1_000_000, "a", 7, "b", 9, 60, 16, 600),
            (3, 3_000_000, "b", 9, "a", 7, 40, 0x80, 700),
        ],
        "pkt_no bigint, us bigint, src_ip string, src_port int, dst_ip string, dst_port int, pkt_len int, "
        "tcp_flags int, tcp_win int",
    ).selectExpr("'c' AS capture_id", "*", "timestamp_micros(us) AS ts", "6 AS proto", "20 AS hdr_len")
    row = build_flows(packets).first()
    assert row["flow_id"] == "a:7-b:9"
    assert (row["total_fwd_packets"], row["total_backward_packets"]) == (1, 2)
    assert row["flow_duration"] == 3_000_000
    assert (row["flow_iat_max"], row["flow_iat_min"]) == (2_000_000, 1_000_000)
    assert (row["bwd_iat_total"], row["fwd_iat_total"]) == (3_000_000, 0)
    assert (row["init_win_bytes_forward"], row["init_win_bytes_backward"]) == (600, 500)
    assert row["cwe_flag_count"] == 1 and row["flow_packets_s"] == pytest.approx(1.0)


def test_flows_need_one_exchange_for_packets_and_one_for_slices(spark, sf_dir):
    packets = adapter(spark, sf_dir, "packets")
    plan = build_flows(packets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2


@pytest.mark.parametrize("slice_us", [1, 7, 10**9])
def test_lag_crosses_slices(spark, slice_us):
    df = spark.range(200).selectExpr("if(id % 3 = 0, NULL, id % 3) AS k", "id * id % 90 AS us", "id")
    want, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["us"], r["id"])):
        want[r["id"]], last[r["k"]] = last.get(r["k"]), r["us"]
    got = skew.lag_in_groups(df, ["k"], "us", ["id"], "before", slice_us).collect()
    assert {r["id"]: r["before"] for r in got} == want


def test_year_long_gap_in_a_hot_flow(spark):
    packets = spark.range(40).selectExpr(
        "'c' AS capture_id", "id AS pkt_no", "timestamp_seconds(1500000000 + if(id = 39, 40000000, id)) AS ts",
        "'10.0.0.1' AS src_ip", "80 AS src_port", "'10.0.0.2' AS dst_ip", "90 AS dst_port", "17 AS proto",
        "8 AS hdr_len", "20 AS pkt_len", "0 AS tcp_flags", "cast(NULL AS INT) AS tcp_win",
    )
    whole, cut = build_flows(packets, slice_us=10**17).first(), build_flows(packets).first()
    assert cut["flow_iat_std"] == pytest.approx(whole["flow_iat_std"], rel=1e-6)
    assert cut["flow_iat_max"] == whole["flow_iat_max"]


def burst(spark):
    """Nine of ten packets of the capture lie inside one second, a third of those inside one microsecond."""
    return spark.range(6000).selectExpr(
        "if(id % 50 = 0, NULL, 'c') AS capture_id", "id AS pkt_no",
        "timestamp_micros(1700000000000000 + if(id % 10 = 0, id * 31000, if(id % 3 = 0, 5000007, 5000000 + id * 150))) AS ts",
        "if(id % 4 = 0, '10.0.0.1', '10.0.0.2') AS src_ip", "if(id % 4 = 0, 80, 5000) AS src_port",
        "if(id % 4 = 0, '10.0.0.2', '10.0.0.1') AS dst_ip", "if(id % 4 = 0, 5000, 80) AS dst_port",
        "if(id % 7 = 0, 17, 6) AS proto", "20 AS hdr_len", "int(20 + id % 100) AS pkt_len", "2 AS tcp_flags",
        "int(id % 9999) AS tcp_win",
    )


@pytest.mark.parametrize("scope", ["flow", "capture"])
@pytest.mark.parametrize("slice_us", [10**7, 12_345_678])
def test_burst_is_cut_by_its_load(spark, scope, slice_us):
    """No slice of a burst has twice the bound of packets, and the records stay the same."""
    packets = burst(spark)
    assert rows(build_flows(packets, scope, slice_us, 100)) == rows(build_flows(packets, scope, slice_us=10**17))
    keys = FLOW_KEY if scope == "flow" else ["capture_id"]
    cut = skew.sliced(with_flow_key(packets), keys, "ts_us", slice_us, 100, "pkt_no")
    assert cut.count() == packets.count()
    counts = [r["count"] for r in cut.groupBy(*keys, "__slice").count().collect()]
    assert max(counts) < 200 and len(counts) < 500
    whole = skew.sliced(with_flow_key(packets), keys, "ts_us", slice_us).groupBy(*keys, "__slice").count()
    assert whole.agg({"count": "max"}).first()[0] > 1000


@pytest.mark.parametrize("rows_of_slice", [1, 3, 10**6])
def test_lag_in_slices_by_load(spark, rows_of_slice):
    df = spark.range(400).selectExpr("if(id % 3 = 0, NULL, 'k') AS k", "(id * id) % 97 - 40 AS us", "id")
    plain = skew.lag_in_groups(df, ["k"], "us", ["id"], "before", 10**17).collect()
    cut = skew.lag_in_groups(df, ["k"], "us", ["id"], "before", 10, rows_of_slice).collect()
    assert sorted(map(str, cut)) == sorted(map(str, plain))
