from __future__ import annotations

import json
import socket
import struct

import pytest
from pyspark.sql import functions as F

from packetloom import schemas
from packetloom.operators import evaluate, events as log
from packetloom.operators.events import to_events
from packetloom.sources import files, pcap, sinks
from packetloom.sources.adapters import adapter
from packetloom.streaming import streams


def ipv4(src, dst, proto, body, fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, fragment, 64, proto, 0,
                       socket.inet_aton(src), socket.inet_aton(dst)) + body


def ipv6(src, dst, nxt, body):
    return struct.pack(">IHBB16s16s", 6 << 28, len(body), nxt, 64,
                       socket.inet_pton(socket.AF_INET6, src), socket.inet_pton(socket.AF_INET6, dst)) + body


def tcp(sport, dport, flags, win, payload=b"", words=5):
    return struct.pack(">HHIIHHHH", sport, dport, 1, 2, (words << 12) | flags, win, 0, 0) + b"\0" * (words * 4 - 20) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ether(kind, body, vlan=False):
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return b"\x01" * 12 + tag + struct.pack(">H", kind) + body


def capture(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for sec, us, frame in frames:
        out += struct.pack(order + "IIII", sec, us * (1000 if nano else 1), len(frame), len(frame)) + frame
    return out


FRAMES = [
    (1700000000, 10, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 0x02, 4096, b"", 7)) + b"\0" * 6)),
    (1700000000, 20, ether(0x0800, ipv4("10.0.0.2", "10.0.0.1", 6, tcp(80, 1234, 0x12, 8192, b"hello")), vlan=True)),
    (1700000001, 5, ether(0x86DD, ipv6("2001:db8::1", "2001:db8::2", 17, udp(53, 5353, b"q" * 30)))),
    (1700000001, 6, ether(0x86DD, ipv6("2001:db8::1", "2001:db8::2", 0, b"\x11\0" + b"\0" * 6 + udp(53, 5353, b"q")))),
    (1700000002, 0, ether(0x0806, b"arp" * 10)),  # no IP
    (1700000002, 1, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 1, b"icmp" * 4))),  # no TCP / UDP
    (1700000002, 2, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2), fragment=100))),  # later fragment
    (1700000002, 3, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 6, b"short"))),  # broken TCP
    (1700000003, 7, ether(0x0800, ipv4("10.0.0.9", "8.8.8.8", 17, udp(4000, 53, b"x" * 12)))),
]
WANT = [
    ("10.0.0.1", 1234, "10.0.0.2", 80, 6, 28, 28, 2, 4096, 1700000000000010),
    ("10.0.0.2", 80, "10.0.0.1", 1234, 6, 20, 25, 18, 8192, 1700000000000020),
    ("2001:db8::1", 53, "2001:db8::2", 5353, 17, 8, 38, 0, None, 1700000001000005),
    ("2001:db8::1", 53, "2001:db8::2", 5353, 17, 8, 9, 0, None, 1700000001000006),
    ("10.0.0.9", 4000, "8.8.8.8", 53, 17, 8, 20, 0, None, 1700000003000007),
]


def decoded(df):
    rows = df.withColumn("us", F.unix_micros("ts")).orderBy("capture_id", "pkt_no").collect()
    return [(r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["proto"], r["hdr_len"], r["pkt_len"],
             r["tcp_flags"], r["tcp_win"], r["us"]) for r in rows]


@pytest.mark.parametrize("order, nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_pcap_decoding(spark, tmp_path, order, nano):
    (tmp_path / "cap1.pcap").write_bytes(capture(FRAMES, order, nano))
    df = pcap.read_pcap(spark, str(tmp_path))
    assert decoded(df) == WANT
    assert {r["capture_name"] for r in df.collect()} == {"cap1"}


def test_large_capture_is_cut_exactly(spark, tmp_path):
    """Ranges far smaller than the file give the same rows as one range."""
    frames = []
    for i in range(3000):
        body = udp(1000 + i % 50, 53, bytes([i % 251]) * (i % 300))
        frames.append((1700000000 + i // 10, i % 10, ether(0x0800, ipv4("10.0.0.1", f"10.0.{i % 7}.2", 17, body))))
    (tmp_path / "big.pcap").write_bytes(capture(frames))
    whole = decoded(pcap.read_pcap(spark, str(tmp_path)))
    assert len(whole) == 3000
    assert decoded(pcap.read_pcap(spark, str(tmp_path), chunk=40_000)) == whole


def test_misleading_payload_falls_back(spark, tmp_path):
    """Payloads that look like record chains must not fool the range starts."""
    fake = b"".join(struct.pack("<IIII", 1700000000, 1, 20, 20) + b"z" * 20 for _ in range(60))
    frames = [(1700000000 + i, 0, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 17, udp(7, 9, fake)))) for i in range(40)]
    (tmp_path / "odd.pcap").write_bytes(capture(frames))
    got = decoded(pcap.read_pcap(spark, str(tmp_path), chunk=7_000))
    assert len(got) == 40 and len({r[-1] for r in got}) == 40


def test_damaged_capture_is_read_on_in_many_tasks(spark, tmp_path):
    """Fake chains in some ranges, a broken length in another: the same rows as from one range, and stretches stay short."""
    fake = b"".join(struct.pack("<IIII", 1700000000, 1, 20, 20) + b"z" * 20 for _ in range(200))
    frames = []
    for i in range(1500):
        body = fake if i % 100 in (50, 51) else bytes([i % 251]) * (40 + i % 300)
        frames.append((1700000000 + i, 0, ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 17, udp(7, 9, body)))))
    whole = capture(frames)
    (tmp_path / "odd.pcap").write_bytes(whole)
    at = len(capture(frames[:1200])) + 8
    (tmp_path / "broken.pcap").write_bytes(whole[:at] + struct.pack("<I", 5_000) + whole[at + 4 :])
    want = decoded(pcap.read_pcap(spark, str(tmp_path)))
    assert decoded(pcap.read_pcap(spark, str(tmp_path), chunk=6_000)) == want
    assert len([r for r in want if r[5]]) > 2500


def test_captures_are_read_once(spark, tmp_path, monkeypatch):
    """Ranges read each byte once, apart from the probe at their start and the record behind their end."""
    frames = [(1700000000 + i, 0, ether(0x86DD, ipv6(f"2001:db8::{i % 99}", "::2", 17, udp(7, 9, bytes(60_000))))) for i in range(500)]
    path = tmp_path / "a.pcap"
    path.write_bytes(capture(frames))
    size, chunk, read = path.stat().st_size, 7 << 20, []

    class Counted:
        def __enter__(self):
            self.data = path.read_bytes()
            return self

        def __exit__(self, *_):
            pass

        def read_at(self, n, at):
            read.append(min(n, size - at))
            return self.data[at : at + n]

    monkeypatch.setattr(pcap, "_open", lambda _: Counted())
    files = spark.createDataFrame([(str(path), size)], "path string, size bigint")
    ranges = pcap._ranges(files, chunk).toPandas()
    rows = list(pcap._speculate(iter([ranges])))
    assert sum(int(r["pkt_no"].notna().sum()) for r in rows) == 500 and len(ranges) > 3
    assert sum(read) <= size + len(ranges) * 6 * pcap.MAX_RECORD
    monkeypatch.undo()
    assert pcap.packets_of(files, chunk).groupBy("src_ip").count().count() == 99


def test_bad_files_do_not_end_the_read(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"not a capture, but long enough to look")
    (tmp_path / "UPPER.PCAP").write_bytes(capture(FRAMES))
    (tmp_path / "cut.pcap").write_bytes(capture(FRAMES)[:-20])
    got = pcap.read_pcap(spark, str(tmp_path)).groupBy("capture_name").count().collect()
    assert {r["capture_name"]: r["count"] for r in got} == {"UPPER": len(WANT), "cut": len(WANT) - 1}
    errors = pcap.capture_errors(pcap.list_captures(spark, str(tmp_path))).collect()
    assert {(r["path"].rpartition("/")[2], r["error"]) for r in errors} == {("x.pcap", "no packet capture"), ("cut.pcap", "cut short")}


@pytest.mark.parametrize("chunk", [pcap.CHUNK_BYTES, 4_000_000])
def test_packets_after_a_very_large_record(spark, tmp_path, chunk):
    large = ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 1, b"i" * 60_000)) + b"\0" * (9 << 20)
    good = ether(0x0800, ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2, b"x")))
    frames = [(1700000000, 0, good), (1700000001, 0, large), (1700000002, 0, good), (1700000003, 0, good)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    assert len(decoded(pcap.read_pcap(spark, str(tmp_path), chunk))) == 3


def test_many_vlan_tags_and_extension_headers(spark, tmp_path):
    inner = ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2, b"x"))
    tags = b"".join(struct.pack(">HH", 0x8100, 5) for _ in range(3))
    tagged = bytes(12) + tags + b"\x08\x00" + inner
    options = b"".join(bytes([60, 0]) + bytes(6) for _ in range(11)) + bytes([17, 0]) + bytes(6)
    frames = [(1, 0, tagged), (2, 0, ether(0x86DD, ipv6("::1", "::2", 60, options + udp(3, 4, b"y"))))]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    assert [(r[0], r[1]) for r in decoded(pcap.read_pcap(spark, str(tmp_path)))] == [("10.0.0.1", 1), ("::1", 3)]


def test_equal_names_are_different_captures(spark, tmp_path):
    from packetloom.operators.flows import build_flows

    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "dump.pcap").write_bytes(capture(FRAMES[-1:]))
    packets = pcap.read_pcap(spark, str(tmp_path))
    assert {r["capture_name"] for r in packets.collect()} == {"dump"} and build_flows(packets).count() == 2


def test_archive_survives_reruns_and_lost_jobs(spark, tmp_path, sf_dir, monkeypatch):
    log, old = str(tmp_path / "log"), str(tmp_path / "old")
    events = to_events(adapter(spark, sf_dir, "detections")).withColumn("prediction", F.lit(1))
    sinks.write_events(events, log)
    count = lambda path: sinks.read_events(spark, path, schemas.DETECTIONS).count()
    total = count(log)
    early = events.where("ts < '2024-01-10'").count()

    def lost(*_):
        raise RuntimeError("driver lost")

    # Lost after the copy, before the commit: nothing is gone, a rerun starts over.
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError):
            sinks.archive_events(spark, log, old, "2024-01-10", "t", schemas.DETECTIONS)
    assert count(log) == total
    # Lost between two deletes: a late row for an old day comes in before the rerun and stays.
    with monkeypatch.context() as m:
        m.setattr(type(spark.read), "text", lost)
        with pytest.raises(RuntimeError):
            sinks.archive_events(spark, log, old, "2024-01-10", "t", schemas.DETECTIONS)
    assert count(f"{old}/archive=t") == early and count(log) == total
    sinks.write_events(events.where("ts < '2024-01-10'").limit(1), log)
    for _ in range(3):
        sinks.archive_events(spark, log, old, "2024-01-10", "t", schemas.DETECTIONS)
        assert count(f"{old}/archive=t") == early and count(log) == total - early + 1


def test_csv_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text(" Flow ID,Label\n1,BENIGN\n2,SYN,extra\n3\n")
    (tmp_path / "sub" / "b.csv").write_text("Label,Bytes\nUDP,10\n")
    (tmp_path / ".~lock.c.csv").write_text("Label\nX\n")
    df = files.read_flow_csv(spark, str(tmp_path))
    got = {(r["source_file"], r["Flow ID"], r["Label"], r["Bytes"]) for r in df.collect()}
    assert got == {("a.csv", "1", "BENIGN", None), ("a.csv", "3", None, None), ("b.csv", None, "UDP", "10")}


def test_quoted_headers_breaks_and_extra_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b,c",d\n1,2,3\n4,,\n5,6,7,\n8,"x\ny",9\n')
    df = files.read_flow_csv(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["a", "b,c", "d", "source_file"]
    assert {tuple(r)[:3] for r in df.collect()} == {("1", "2", "3"), ("4", None, None), ("8", "x\ny", "9")}


def test_quoted_breaks_in_envelopes(spark):
    body = 'CSV_CONTENT:/o/a.csv\nx,y\n1,"q\nr"\n2,3,\n4,""\n'
    df = files.decode_csv_messages(spark.createDataFrame([(7, body)], "id bigint, body string"), "body", ["x", "y"], ["id"])
    assert [tuple(r) for r in df.collect()] == [(7, "/o/a.csv", 1, "1", "q\nr"), (7, "/o/a.csv", 3, "4", None)]


def test_growing_files_are_read_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target = tmp_path / "in" / "a.csv"
    target.write_text("x,y\n1,2\n3,")
    done = spark.createDataFrame([], files.PROGRESS)

    def cycle(known, **options):
        grown = files.grown_files(spark, str(tmp_path / "in"), known)
        rows, progress = files.read_appended(grown, ["x", "y"], **options)
        got = sorted((r["x"], r["y"]) for r in rows.collect())
        return got, known.unionByName(spark.createDataFrame(progress.collect(), files.PROGRESS))

    got, done = cycle(done)
    assert got == [("1", "2")]
    with target.open("a") as out:
        out.write("4\n5,6,7\n8,\n")
    (tmp_path / "in" / "b.csv").write_text("x,y\n9,9\n")
    got, done = cycle(done)
    assert got == [("3", "4"), ("8", None), ("9", "9")]
    assert cycle(done)[0] == []
    with target.open("a") as out:
        out.write("10,1\n11,1\n12,1\n")
    got, done = cycle(done, max_bytes=11)
    assert got == [("10", "1"), ("11", "1")]
    assert cycle(done)[0] == [("12", "1")]


def test_csv_folder_without_files(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.read_flow_csv(spark, str(tmp_path))


def test_envelope_edge_cases(spark):
    bodies = ["CSV_CONTENT:/o/a.csv\nx,y\n1,2\n\n3,4,5\n6\n", "CSV_CONTENT:/o/b.csv", "other\nx\n1", "", None]
    df = files.decode_csv_messages(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", ["x", "y"])
    assert [(r["file_path"], r["x"], r["y"]) for r in df.collect()] == [("/o/a.csv", "1", "2"), ("/o/a.csv", "6", None)]


@pytest.fixture()
def events(spark, sf_dir):
    return log.to_events(adapter(spark, sf_dir, "detections")).withColumn("prediction", F.lit(1))


def test_event_sinks(spark, tmp_path, events):
    out = str(tmp_path / "events")
    sinks.write_events(events, out)
    sinks.write_events(events.limit(0), out)
    back = sinks.read_events(spark, out, schemas.DETECTIONS)
    assert back.count() == events.count()
    assert back.select("event_uid").distinct().count() == events.select("event_uid").distinct().count()
    sinks.archive_events(spark, out, str(tmp_path / "old"), "2024-01-10", "t1", schemas.DETECTIONS)
    kept = sinks.read_events(spark, out, schemas.DETECTIONS)
    moved = sinks.read_events(spark, str(tmp_path / "old" / "archive=t1"), schemas.DETECTIONS)
    assert kept.count() + moved.count() == events.count()
    assert kept.where("ts < '2024-01-10'").count() == 0 and moved.count() > 0
    sinks.write_timeline(events, str(tmp_path / "timeline"))
    assert spark.read.option("header", True).csv(str(tmp_path / "timeline")).count() == events.count()


def test_evaluation_sink(spark, tmp_path, sf_dir):
    sinks.write_evaluation(evaluate.scored_counts(adapter(spark, sf_dir, "scored")), str(tmp_path))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    assert read("per_file_metrics").count() == 7
    assert read("confusion_matrix").columns == ["y_true", "BENIGN", "LDAP", "SYN", "UDP"]
    assert read("confusion_matrix_normalized").count() == 4
    assert read("overall_metrics").count() == 1


def test_csv_stream_reads_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n3,4,5\n")

    def drain():
        rows = streams.read_csv_stream(spark, src, ["x", "y"], max_files=1)
        streams.write_stream(rows, out, state, available_now=True).awaitTermination()
        return {(r["x"], r["source_file"]) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    assert drain() == ({("1", "a.csv")}, 1)
    (tmp_path / "in" / "b.csv").write_text("x,y\n9,9\n")
    assert drain() == ({("1", "a.csv"), ("9", "b.csv")}, 2)


def test_capture_stream_to_flows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pcap").write_bytes(capture(FRAMES))
    found = streams.capture_stream(spark, str(tmp_path / "in"))
    streams.start_capture_flows(found, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    flows = spark.read.parquet(str(tmp_path / "out"))
    assert {r["flow_id"] for r in flows.collect()} == {
        "10.0.0.1:1234-10.0.0.2:80", "2001:db8::1:53-2001:db8::2:5353", "10.0.0.9:4000-8.8.8.8:53",
    }


def test_scoring_stream_is_repeatable(spark, tmp_path, sf_dir):
    """Two runs over the same input log the same event ids."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def score(batch):
        return batch.selectExpr(
            "cast(ts AS TIMESTAMP) AS ts", "event_id", "if(value > 100, 'SYN_FLOOD', 'normal') AS prediction_label",
            "value / 500 AS confidence", "'stream' AS source",
        )

    ids = []
    for run in ("a", "b"):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        out = str(tmp_path / f"out{run}")
        query = streams.start_scoring(rows, score, out, str(tmp_path / f"state{run}"), ["event_id", "source"], True)
        query.awaitTermination()
        ids.append({r["event_uid"] for r in spark.read.json(out).collect()})
        alerts = streams.event_feed(spark, out, schemas.DETECTIONS)
        streams.start_batch_alerts(alerts, str(tmp_path / f"alerts{run}"), str(tmp_path / f"astate{run}"), True).awaitTermination()
        assert spark.read.json(str(tmp_path / f"alerts{run}")).count() == 1
    assert ids[0] == ids[1] and len(ids[0]) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_feature_sink(spark, tmp_path, sf_dir):
    feats, mapping = spark.range(3).selectExpr("id", "id % 2 AS y"), spark.createDataFrame([("a", 0)], "label string, code bigint")
    sinks.write_features(feats, mapping, str(tmp_path))
    sinks.write_predictions(feats, str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == 3
    assert json.loads(next((tmp_path / "label_mapping").glob("*.json")).read_text())["label"] == "a"
