from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.ip import client_ip, is_public_ip, normalize_ip
from packetloom.functions.labels import file_name, file_stem, label_from_filename
from packetloom.functions.metrics import dynamic_metrics_from_map
from packetloom.functions.numeric import finite, sanitize
from packetloom.functions.text import format_value, template


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "record, want",
    [
        ({"avg_pkt_size": "512", "SYN Flag Count": "33", "udp_rate": "120"}, (512.0, 33.0, 120.0)),
        ({"packet_length_mean": "100", "syn_rate": "8", "udp_count": "12"}, (100.0, 8.0, 12.0)),
        ({"Protocol": "17", "Flow Packets/s": "2.5", "Packet Length Mean": "400"}, (400.0, 0.0, 2.5)),
        ({"SYN Flag Count": "3", "Flow Duration": "1500000", "Packet Length Mean": "500"}, (500.0, 2.0, 0.0)),
        ({"Protocol": "6", "SYN Flag Count": "0", "Flow Packets/s": "123.45", "Packet Length Mean": "321"},
         (321.0, 123.45, 0.0)),
        ({"Flow Bytes/s": "Infinity", "Flow Packets/s": "1e309", "Protocol": "6"}, (0.0, 0.0, 0.0)),
    ],
)
def test_dynamic_metrics(spark, record, want):
    df = spark.createDataFrame([(record,)], "record map<string,string>")
    row = dynamic_metrics_from_map(df, "record").first()
    assert (row["pkt_len"], row["syn_count"], row["udp_count"]) == want


def test_udp_per_minute_option(spark):
    df = spark.createDataFrame([({"Protocol": "17", "Flow Packets/s": "2.5"},)], "record map<string,string>")
    assert dynamic_metrics_from_map(df, "record", udp_per_minute=True).first()["udp_count"] == 150.0


def reference_ip(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    if address.version == 6 and address.ipv4_mapped:
        n = int(address.ipv4_mapped)
        return f"::ffff:{n >> 16:x}:{n & 65535:x}"
    return str(address)


def test_ip_text_against_standard_library(spark):
    rng = random.Random(7)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:0:0:2:0:0:0:3", "fe80::A",
             "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "2001:db8::0:1", "g::1", "12345::", "01.2.3.4", "1.2.3", "256.1.1.1",
             "1.2.3.4", "0:0:0:0:0:0:0:0", "1:0:2:0:3:0:4:0", "::1.2.3", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    for _ in range(400):
        groups = [f"{rng.choice([0, 0, 0, rng.randrange(65536)]):x}".zfill(rng.choice([1, 4])) for _ in range(8)]
        texts.append(":".join(groups))
        cut = sorted(rng.sample(range(9), 2))
        texts.append(":".join(groups[: cut[0]]) + "::" + ":".join(groups[cut[1] :]))
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", normalize_ip(F.col("x")).alias("r"))
    for row in df.collect():
        assert row["r"] == reference_ip(row["x"]), row["x"]


@pytest.mark.parametrize(
    "raw, want",
    [(' "1.2.3.4" ', "1.2.3.4"), ("1.2.3.4:80", "1.2.3.4"), ("[2001:DB8::1]:443", "2001:db8::1"), ("fe80::1%eth0", "fe80::1"),
     ("unknown", None), ("None", None), ("", None), ("host.example", None)],
)
def test_bare_address(spark, raw, want):
    assert one(spark, normalize_ip(F.col("x")), raw) == want


@pytest.mark.parametrize(
    "ip, want",
    [("8.8.8.8", True), ("127.0.0.1", False), ("10.1.1.1", False), ("172.32.0.1", True), ("100.64.0.1", False),
     ("2001:db8::1", False), ("2606:4700::1111", True), ("fe80::1", False), ("224.0.0.1", True)],
)
def test_public(spark, ip, want):
    assert one(spark, is_public_ip(F.col("x")), ip) is want


def test_client_ip_headers(spark):
    df = spark.createDataFrame(
        [(0, {"x-real-ip": "198.18.7.7", "X-FORWARDED-FOR": "unknown,, 'bad' , 203.0.113.90:4711,198.18.0.1"}), (1, {}),
         (2, {"Forwarded": 'by=9.9.9.9, for=_hidden, For="[2A00:0:0::00fe%en1]:80"'}),
         (3, {"X-Real-Ip": "not an address", "X-Client-IP": " 77.1.2.3 "}), (4, None)],
        "i int, h map<string,string>",
    )
    got = [r[0] for r in df.orderBy("i").select(client_ip(F.col("h"), F.lit("192.0.2.200"))).collect()]
    assert got == ["203.0.113.90", "192.0.2.200", "2a00::fe", "77.1.2.3", "192.0.2.200"]


def test_number_text_matches_printf(spark):
    rng = random.Random(3)
    values = [0.065, 0.285, 2.5, 0.125, 1e-7, 123456.789, 0.5, 1.005] + [rng.uniform(0, 10) for _ in range(200)]
    values += [round(rng.uniform(0, 1), 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = df.select("x", format_value(F.col("x"), ".2f").alias("a"), format_value(F.col("x"), ".1%").alias("b"),
                    format_value(F.col("x"), ".0f").alias("c"))
    for row in out.collect():
        assert (row["a"], row["b"], row["c"]) == (f"{row['x']:.2f}", f"{row['x']:.1%}", f"{row['x']:.0f}")


def test_template_ignores_unknown_fields(spark):
    expr = template("{a}-{missing}-{b:.1%}", {"a": F.col("x"), "b": F.lit(0.256)})
    assert one(spark, expr, "v") == "v--25.6%"


@pytest.mark.parametrize("raw, want", [("1e309", None), ("Infinity", None), ("nan", None), ("12d", None), (" 7 ", 7.0), ("", None)])
def test_finite(spark, raw, want):
    assert one(spark, finite(F.col("x")), raw) == want


@pytest.mark.parametrize("raw, want", [(float("nan"), 0.0), (float("inf"), 1e12), (float("-inf"), -1e12), (2.0, 2.0)])
def test_sanitize(spark, raw, want):
    assert one(spark, sanitize(F.col("x")), raw, "double") == want


def test_file_labels(spark):
    assert one(spark, label_from_filename(F.col("x")), "UDPLag.csv") == "udplag_flood"
    assert one(spark, label_from_filename(F.col("x"), "replay"), "/a/capture.v2.csv") == "capture.v2"
    assert one(spark, file_name(F.col("x")), "F:\\raw\\x.pcap") == "x.pcap"
    assert one(spark, file_stem(F.col("x")), "/raw/.hidden") == ".hidden"
