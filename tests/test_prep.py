from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.operators import enrich, prep, sampling, sizing
from packetloom.operators.models import soft_vote


@pytest.mark.parametrize("make", [
    lambda r: [r.choice([0.0, 1.0, 5.0]) for _ in range(1001)],
    lambda r: [r.gauss(0, 1e9) for _ in range(1000)],
    lambda r: [0.0] * 700 + [r.random() for _ in range(301)],
    lambda r: [1e308, -1e308, 3.0, 4.0],
    lambda r: [10.0 ** r.randint(-30, 30) for _ in range(999)],
])
def test_medians_are_exact(spark, make):
    values = make(random.Random(1))
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("inf"), None)], "v double, e double")
    got = prep.fit_medians(df, ["v", "e"])
    assert got == {"v": statistics.median(values), "e": 0.0}


def test_selection_matches_full_sort(spark):
    """One group holds most rows; both ways of selecting agree with a sort."""
    df = spark.range(6000).selectExpr("id", "if(id % 10 < 7, 'hot', concat('g', id % 3)) AS g")
    for n in (7, 1500, 10_000):
        got = {(r["g"], r["id"]) for r in sampling.take_per_group(df, ["g"], ["id"], n, 42).collect()}
        marked = sampling.mark_per_group(df, ["g"], ["id"], n, 42).where("taken")
        rows = df.withColumn("h", sampling.order_hash(42, ["id"])).collect()
        want = set()
        for g in {r["g"] for r in rows}:
            want |= {(g, r["id"]) for r in sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))[:n]}
        assert got == want
        assert {(r["g"], r["id"]) for r in marked.collect()} == want


@pytest.mark.parametrize("edge_rows", [1, 40])
def test_selection_narrows_large_buckets_to_the_same_rows(spark, edge_rows):
    """Bounds far below the bucket sizes: finer digits, groups cut at different depths, null and short groups."""
    df = spark.range(4000).selectExpr("id", "if(id % 10 < 7, 'hot', if(id % 10 = 7, NULL, concat('g', id % 3))) AS g")
    rows = [(r["h"], r["g"], r["id"]) for r in df.withColumn("h", sampling.order_hash(5, ["id"])).collect()]
    quota = spark.createDataFrame([("hot", 1234), (None, 17), ("g0", 0), ("g1", 10_000)], "g string, n bigint")
    limits = {"hot": 1234, None: 17, "g0": 0, "g1": 10_000, "g2": 0}
    want = {i for g, k in limits.items() for _, _, i in sorted((r for r in rows if r[1] == g), key=lambda r: (r[0], r[2]))[:k]}
    got = sampling.mark_per_group(df, ["g"], ["id"], quota, 5, edge_rows=edge_rows)
    assert {r["id"] for r in got.where("taken").collect()} == want and got.count() == 4000
    overall = sampling.mark_per_group(df, [], ["id"], 999, 5, edge_rows=edge_rows)
    assert {r["id"] for r in overall.where("taken").collect()} == {i for _, _, i in sorted(rows, key=lambda r: (r[0], r[2]))[:999]}


def test_rows_that_repeat_their_keys_are_parted_by_the_whole_row(spark):
    df = spark.range(900).selectExpr("1 AS k", "id", "map('a', id) AS m")
    ranked = sampling.mark_per_group(df, [], ["k"], 321, 5, edge_rows=3)
    taken = {r["id"] for r in ranked.where("taken").collect()}
    assert len(taken) == 321 and ranked.count() == 900
    again = sampling.mark_per_group(df.repartition(5), [], ["k"], 321, 5, edge_rows=3)
    assert {r["id"] for r in again.where("taken").collect()} == taken
    # Rows alike in every column stay together, and their number is still exact.
    alike = spark.range(900).selectExpr("1 AS k")
    assert sampling.mark_per_group(alike, [], ["k"], 321, 5, edge_rows=3).where("taken").count() == 321


@pytest.mark.parametrize("n", [1000, 1001])
def test_null_groups_are_selected_like_others(spark, n):
    df = spark.range(3000).selectExpr("id", "cast(NULL AS string) AS g")
    assert sampling.take_per_group(df, ["g"], ["id"], n).count() == n
    quota = spark.createDataFrame([(None, n), ("a", 5)], "g string, n bigint")
    assert sampling.take_per_group(df, ["g"], ["id"], quota).count() == n
    assert sampling.online_window(df, "g", ["id"], n).count() == n


def test_null_labels_are_split_like_others(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 2 = 0, NULL, 'a') AS y")
    got = {(r["y"], r["is_test"]): r["count"] for r in sampling.stratified_split(df, "y", ["id"]).groupBy("y", "is_test").count().collect()}
    assert got == {(None, True): 300, (None, False): 1200, ("a", True): 300, ("a", False): 1200}


def test_split_is_exact_and_complete(spark):
    df = spark.range(1003).selectExpr("id", "if(id % 10 < 9, 'a', 'b') AS y")
    out = sampling.stratified_split(df, "y", ["id"], 0.2, 1)
    counts = {(r["y"], r["is_test"]): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    assert sum(counts.values()) == 1003
    assert counts[("a", True)] + counts[("b", True)] == 201
    assert abs(counts[("b", True)] - 20) <= 1


def test_dense_codes_agree_on_both_paths(spark):
    df = spark.range(500).selectExpr("concat('c', id % 2) AS c", "sha1(string(id)) AS v")
    few = {(r["c"], r["v"]): r["code"] for r in sizing.dense_codes(df, ["c"], "v").collect()}
    many = {(r["c"], r["v"]): r["code"] for r in sizing.dense_codes(df, ["c"], "v", local_rows=10).collect()}
    assert few == many and max(few.values()) == 249


def test_small_only_broadcasts_within_the_bound(spark):
    left, right = spark.range(100), spark.range(50)
    plan = lambda r: left.join(r, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sizing.small(right, 50)) and "broadcast" not in plan(sizing.small(right, 49))


def test_label_column(spark):
    assert prep.resolve_label_column(["a", " LABEL "]) == " LABEL "
    assert prep.resolve_label_column(["Attack", "Class"]) == "Class"
    assert prep.resolve_label_column(["Mine", "Label"], "mine") == "Mine"
    with pytest.raises(KeyError):
        prep.resolve_label_column(["a", "b"])


def test_numeric_labels_pass_through(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "y int")
    coded, _ = prep.encode_labels(df, "y", "code")
    assert sorted(r["code"] for r in coded.collect()) == [1, 3]


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    means, stds = prep.fit_scaler(df, ["a", "b"])
    assert stds == {"a": 1.0, "b": 1.0} and means == {"a": 5.0, "b": 2.0}


def test_two_classes_needed(spark):
    with pytest.raises(ValueError):
        prep.check_two_classes(spark.createDataFrame([("x",), (None,)], "y string"), "y")


def test_profile_round_trip(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:00", "1", "tcp", None), ("bad", "Infinity", "udp", None), (None, "3", None, None)],
        "`Time Stamp` string, n string, k string, empty string",
    )
    profile = prep.fit_profile(df)
    assert profile.kinds == {"Time Stamp": "datetime", "n": "numeric", "k": "categorical", "empty": "numeric"}
    assert profile.fills["n"] == 2.0 and profile.fills["empty"] == 0.0
    new = spark.createDataFrame([("icmp", "x")], "k string, extra string")
    row = prep.apply_fill(prep.encode(new, profile), profile.fills).first()
    assert row["k"] == -1.0 and row["n"] == 2.0 and "extra" not in row.asDict()


def test_soft_vote_ties_go_to_the_lowest_class(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4], [0.2, 0.4, 0.4])], "a array<double>, b array<double>")
    row = soft_vote(df, ["a", "b"], 3).first()
    assert row["prediction"] == 1 and row["confidence"] == pytest.approx(0.4)


def test_geo_paths_agree(spark, monkeypatch):
    ranges = spark.createDataFrame([(16777216, 33554431, "A"), (134744064, 134744072, "B")], "ip_lo bigint, ip_hi bigint, country string")
    events = spark.createDataFrame([("1.2.3.4",), ("8.8.8.8",), ("8.8.8.9",), ("10.0.0.1",), ("x",), (None,), ("2606:4700::1",)], "ip string")
    pick = lambda: sorted(
        (str(r["ip"]), r["country"], r["geo_resolved"], r["geo_reason"])
        for r in enrich.geo_enrich(events, "ip", ranges, ["country"]).collect()
    )
    broadcast = pick()
    assert ("8.8.8.8", "B", True, None) in broadcast and ("8.8.8.9", None, False, "not_found") in broadcast
    assert ("10.0.0.1", None, False, "non_public_ip") in broadcast and ("x", None, False, "missing_or_invalid_ip") in broadcast
    monkeypatch.setattr(enrich, "small", lambda df: df)
    assert pick() == broadcast


def test_scan_merge_counts_every_pair_once(spark):
    base = spark.range(50).selectExpr("'t' AS trace_id", "timestamp_seconds(id * 7) AS ts", "id AS event_uid")
    scans = spark.range(20).selectExpr("'t' AS trace_id", "timestamp_seconds(id * 13) AS scan_ts", "id AS scan")
    got = {(r["event_uid"], r["scan"]) for r in enrich.merge_with_scans(base, scans, 10).collect()}
    want = {(a, b) for a in range(50) for b in range(20) if abs(a * 7 - b * 13) <= 10}
    assert got == want
    assert enrich.merge_with_scans(base, scans, 10).count() == len(want)


def test_union_of_differing_columns(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(2))
    assert prep.union_files([a, b]).columns == ["id", "x", "y"]


def test_small_selection_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS g")
    plan = sampling.take_per_group(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]
