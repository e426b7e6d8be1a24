"""Streams against their batch twins, the growing CSV source, scan joins and address ranges."""

from __future__ import annotations

import ipaddress
import random
import warnings

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from packetloom.operators import enrich
from packetloom.operators.flows import FLOW_COLUMNS
from packetloom.sources import growing_csv
from packetloom.streaming import ordered_sessions, streams

PACKET = (
    "capture_id string, pkt_no bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, proto int, "
    "hdr_len int, pkt_len int, tcp_flags int, tcp_win int"
)


def packets(spark, rows):
    df = spark.createDataFrame(rows, PACKET.replace("ts timestamp", "us bigint"))
    return df.withColumn("ts", F.timestamp_micros("us")).select(*[c.split()[0] for c in PACKET.split(", ")])


def burst(rng, n, span):
    """Packets of a few flows, in any order, times down to the microsecond, some of them equal."""
    rows = []
    for i in range(n):
        a, b = rng.sample([("10.0.0.1", 1000), ("10.0.0.2", 80), ("192.168.0.9", 443)], 2)
        rows.append(("c", i, rng.randrange(span) * 250_000 + rng.choice([0, 0, 7, 123_456]), *a, *b, rng.choice([6, 17]),
                     20, rng.randrange(20, 1500), rng.randrange(256), rng.choice([None, 512, 4096])))
    return rows


def plain(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def drop_files(spark, rows, folder, name):
    packets(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_session_stream_equals_its_batch_twin_on_every_column(spark, tmp_path):
    rng = random.Random(4)
    rows = burst(rng, 900, 4000)
    rows.sort(key=lambda r: r[2] // 20_000_000)  # late by at most 20 seconds
    for k in range(4):
        drop_files(spark, rows[k * 225 : (k + 1) * 225], tmp_path / "in", f"p{k}")
    end = rows[0][:2] + (4_000_000_000_000,) + rows[0][3:]
    drop_files(spark, [("end", *end[1:])], tmp_path / "in", "p9")
    source = spark.readStream.schema(PACKET).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    with ordered_sessions.rocksdb_state(spark):
        stream = ordered_sessions.ordered_session_stream(source.parquet(str(tmp_path / "in")), 15, "60 seconds")
        streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == FLOW_COLUMNS
    twin = ordered_sessions.ordered_sessions(packets(spark, rows), 15)
    assert plain(out) == plain(twin) and twin.count() > twin.select("flow_id", "protocol").distinct().count()


def test_running_sessions_are_one_row_whatever_the_packets():
    session = None
    sizes = set()
    for i in range(3000):
        packet = dict.fromkeys(ordered_sessions.PACKET, 1) | {"ts_us": i * i, "pkt_no": i, "is_fwd": i % 3 > 0, "win": None}
        session = ordered_sessions.take_packet(session, packet)
        sizes.add(len(session))
    assert sizes == {len(ordered_sessions.SESSION_FIELDS)} and session["flow_iat_c"] == 2999
    assert session["flow_iat_sum"] == session["last_us"] - session["first_us"] == 2999**2
    assert session["flow_iat_sq"] == sum((2 * i + 1) ** 2 for i in range(2999))


def take(spark, folder, tmp_path, columns=("a", "b"), **how):
    df = growing_csv.read_growing_csv(spark, str(folder), list(columns), **how)
    streams.write_stream(df, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def test_growing_files_give_every_row_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one, two = folder / "one.csv", folder / "two.csv"
    one.write_text("a,b\n1,x\n2,y\n3,unfinis")
    two.write_text('b,a,extra\n"q, r",4,z\n,5\n')
    first = [("1", "x", "one.csv"), ("2", "y", "one.csv"), ("4", "q, r", "two.csv"), ("5", None, "two.csv")]
    assert take(spark, folder, tmp_path) == sorted(first, key=str)
    with one.open("a") as f:
        f.write("hed\n6,too,many\n7,w\r\n")
    more = [("3", "unfinished", "one.csv"), ("7", "w", "one.csv")]
    assert take(spark, folder, tmp_path) == sorted(first + more, key=str)
    two.write_text("a\n8\n")  # rotated, shorter, with another header
    rotated = [("8", None, "two.csv")]
    assert take(spark, folder, tmp_path) == sorted(first + more + rotated, key=str)
    assert take(spark, folder, tmp_path) == sorted(first + more + rotated, key=str)


def test_rotation_to_a_longer_file_is_seen_by_its_beginning(tmp_path):
    path = tmp_path / "x.csv"
    fs, _ = growing_csv.open_path(str(path))

    def now(last, budget=None):
        return growing_csv.advance(fs, [(str(path), path.stat().st_size)], last, budget)

    path.write_text("a\n" + "first\n" * 40)
    before = now({})
    path.write_text("a\n" + "other\n" * 400)
    after = now(before)
    parts = growing_csv.ranges(before, after)
    assert parts[0].first == 0 and parts[-1].end == path.stat().st_size
    path.write_text("a\n" + "other\n" * 500)
    grown = now(after)
    assert growing_csv.ranges(after, grown)[0].first == after[str(path)][0] and not growing_csv.ranges(grown, grown)


def test_a_budget_bounds_a_trigger_and_ranges_part_no_line(tmp_path, monkeypatch):
    path = tmp_path / "x.csv"
    lines = [f"{i},{'v' * (i % 37)}" for i in range(500)]
    path.write_text("a,b\n" + "\n".join(lines) + "\n")
    fs, _ = growing_csv.open_path(str(path))
    monkeypatch.setattr(growing_csv, "RANGE_BYTES", 97)
    last, rows, steps = {}, [], 0
    while True:
        end = growing_csv.advance(fs, [(str(path), path.stat().st_size)], last, 1000)
        parts = growing_csv.ranges(last, end)
        if not parts:
            break
        assert sum(p.end - p.start for p in parts) <= 1000
        for part in parts:
            for batch in growing_csv.read_range(part, ["a", "b"]):
                rows += [f"{a},{b or ''}" for a, b in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True)]
        last, steps = end, steps + 1
    assert rows == lines and steps > 5


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_scan_joins_keep_each_row_as_often_as_sql(spark, how):
    rng = random.Random(how)
    at = lambda: rng.randrange(40) * 5
    left = [(i, rng.choice(["a", "b", None]), None if i == 7 else at()) for i in range(60)]
    right = [(100 + i, rng.choice(["a", "c", None]), at()) for i in range(20)]
    pairs = [(a, b) for a in left for b in right if a[1] and a[1] == b[1] and a[2] is not None and abs(a[2] - b[2]) <= 10]
    want = [(a[0], a[1], b[0]) for a, b in pairs]
    want += [(a[0], a[1], None) for a in left if how in ("left", "full") and a not in [p[0] for p in pairs]]
    want += [(None, b[1], b[0]) for b in right if how in ("right", "full") and b not in [p[1] for p in pairs]]
    one = spark.createDataFrame(left, "d int, trace_id string, s int").select("d", "trace_id", F.timestamp_seconds("s").alias("ts"))
    two = spark.createDataFrame(right, "k int, trace_id string, s int").select("k", "trace_id", F.timestamp_seconds("s").alias("scan_ts"))
    joined = enrich.merge_with_scans(one, two, 10, how)
    assert joined.columns == ["d", "trace_id", "ts", "k", "scan_ts"]
    assert sorted((tuple(r) for r in joined.select("d", "trace_id", "k").collect()), key=str) == sorted(want, key=str)


def test_narrowest_range_of_either_family(spark):
    ranges = spark.createDataFrame(
        [("2a00::", "2a0f:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "wide"), ("2a01:1::", "2a01:1:ffff:ffff:ffff:ffff:ffff:ffff", "inner"),
         ("2a01:1::5", "2a01:1::9", "five"), ("2a01:1::7", "2a01:1::b", "later five"), ("8.0.0.0", "8.255.255.255", "eight"),
         ("8.8.0.3", "8.8.0.6", "odd"), ("9.0.0.9", "9.0.0.1", "backwards"), ("x", "9.9.9.9", "bad"), (None, None, "none")],
        "ip_lo string, ip_hi string, owner string",
    )
    want = {
        "2a02::1": "wide", "2a01:1::4": "inner", "[2A01:1::5]:80": "five", "2a01:1::8": "five", "2a01:1::a": "later five",
        "2a10::1": None, "8.1.2.3": "eight", "8.8.0.3": "odd", "8.8.0.7": "eight", "9.0.0.5": None, "10.0.0.1": None, "junk": None,
    }
    events = spark.createDataFrame([(ip, i) for i, ip in enumerate([*want, None])], "ip string, owner_id int")
    found = {r.ip: r for r in enrich.geo_enrich_any(events, "ip", ranges, ["owner"]).collect()}
    assert {ip: found[ip].owner for ip in want} == want and found[None].geo_reason == "missing_or_invalid_ip"
    assert found["10.0.0.1"].geo_reason == "non_public_ip" and found["2a10::1"].geo_reason == "not_found"
    assert enrich.geo_enrich_any(events, "ip", ranges.limit(0), ["owner"]).where("geo_resolved").count() == 0


def test_blocks_of_ranges_are_whole_prefixes_whatever_the_frame(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [("0.0.0.0", "255.255.255.255"), ("::", "f" * 4 + ":ffff" * 7), ("::", "::"), ("1.2.3.4", "1::"), ("9.0.0.9", "9.0.0.1"), ("x", "::")]
    for kind, size in ((ipaddress.IPv4Address, 32), (ipaddress.IPv6Address, 128)):
        ends = [sorted(rng.getrandbits(rng.randrange(1, size + 1)) for _ in "ab") for _ in range(12)]
        pairs += [tuple(str(kind(e)) for e in pair) for pair in ends]
    want = set()
    for low, high in pairs[:3] + pairs[6:]:
        a, z = ipaddress.ip_address(low), ipaddress.ip_address(high)
        lift, more = (0xFFFF << 32, 96) if a.version == 4 else (0, 0)
        for b in ipaddress.summarize_address_range(a, z):
            want.add((b.prefixlen + more, f"{int(b.network_address) + lift:032x}", f"{int(z) - int(a):032x}", f"{int(a) + lift:032x}", f"{low}-{high}"))
    ranges = spark.createDataFrame([(a, z, f"{a}-{z}") for a, z in pairs], "ip_lo string, ip_hi string, owner string")
    for most in (enrich.BLOCK_ROWS, 3):
        monkeypatch.setattr(enrich, "BLOCK_ROWS", most)
        got = [tuple(r) for r in enrich.prefix_blocks(ranges, ["owner"]).collect()]
        assert len(got) == len(want) and set(got) == want
    assert enrich.prefix_lengths(ranges) == sorted({w[0] for w in want})


def test_blocks_are_not_broadcast_for_the_size_of_their_ranges(spark):
    # Each range makes 71 blocks, so the planner sees a seventieth of what it would broadcast.
    ranges = spark.range(40).selectExpr(
        "printf('2a00:%04x:0:0:0:0:0:0', id) AS ip_lo", "printf('2a00:%04x:0:ff:ffff:ffff:ffff:fffd', id) AS ip_hi", "id AS owner"
    )
    # One address in several spellings, and others in none.
    events = spark.range(200).selectExpr("id", "if(id % 2 = 0, printf('2A00:%x::5', id % 50), concat('[2a00:', hex(id % 50), '::5]:', id)) AS ip")
    out = enrich.geo_enrich_any(events, "ip", ranges, ["owner"])
    assert out.columns == ["geo_ip", "id", "ip", "owner", "geo_provider", "geo_resolved", "geo_reason"]
    rows = out.collect()
    assert len(rows) == 200 and all(r.owner == (r.id % 50 if r.id % 50 < 40 else None) and r.geo_ip == f"2a00:{r.id % 50:x}::5".replace(":0::", "::") for r in rows)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_core_queries_do_not_need_the_corpus_ones(monkeypatch):
    def fails(name):
        raise ImportError(name)

    monkeypatch.setattr(entry_module, "import_module", fails)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        names = set(entry_module.queries())
    assert len(names) > 150 and not any(n.startswith("op") and n[2].isdigit() for n in names) and said
