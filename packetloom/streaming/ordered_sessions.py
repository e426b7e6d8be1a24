"""STR4: session flow records with every column of a batch record, ordered gaps included, on a stream.

Gaps between packets need packet order, and a stream delivers packets in any
order within the watermark's delay. Each flow therefore keeps a buffer of the
packets that the watermark has not passed yet, and one row of running moments
for the packets before. An event-time timer drains the buffer in order; a
second one closes the session once the watermark is an idle length past its
last packet. State per flow is bounded by the packets of one delay plus one
row, however long the session lives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom.operators.flows import (
    FLOW_KEY,
    IAT,
    LENGTHS,
    SUMS,
    build_flows,
    flow_measures,
    flow_records,
    with_flow_key,
)

MOMENTS = LENGTHS + IAT
# Columns of a packet that the running moments read, in state order.
PACKET = {
    "ts_us": "bigint", "pkt_no": "bigint", "is_fwd": "boolean", "all_len": "bigint", "fwd_seg": "bigint", "win": "bigint",
    **dict.fromkeys(SUMS, "bigint"),
}
BUFFER = ", ".join(f"{c} {kind}" for c, kind in PACKET.items())
SESSION_FIELDS = {
    "first_us": "bigint", "last_us": "bigint", "fwd_last": "bigint", "bwd_last": "bigint", "fwd_win": "bigint",
    "bwd_win": "bigint", "fwd_seg": "bigint", **dict.fromkeys(SUMS, "bigint"),
    **{f"{m}_{s}": "decimal(38,0)" if s == "sq" else "bigint" for m in MOMENTS for s in ("c", "sum", "max", "min", "sq")},
}
SESSION = ", ".join(f"{c} {kind}" for c, kind in SESSION_FIELDS.items())
STORE_CLASS = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(packet: tuple) -> tuple:
    return packet[0], packet[1] is not None, packet[1] or 0


def _add(session: dict, name: str, value: int) -> None:
    session[f"{name}_c"] += 1
    session[f"{name}_sum"] = (session[f"{name}_sum"] or 0) + value
    session[f"{name}_sq"] = (session[f"{name}_sq"] or 0) + value * value
    high, low = session[f"{name}_max"], session[f"{name}_min"]
    session[f"{name}_max"] = value if high is None or value > high else high
    session[f"{name}_min"] = value if low is None or value < low else low


def _opened(packet: dict) -> dict:
    session = dict.fromkeys(SESSION_FIELDS)
    session.update({f"{m}_c": 0 for m in MOMENTS}, **dict.fromkeys(SUMS, 0), first_us=packet["ts_us"])
    return session


def take_packet(session: dict | None, packet: dict) -> dict:
    """The session after its next packet in order; ``None`` opens one."""
    if session is None:
        session = _opened(packet)
    at, side = packet["ts_us"], "fwd" if packet["is_fwd"] else "bwd"
    if session["last_us"] is not None:
        _add(session, "flow_iat", at - session["last_us"])
    if session[f"{side}_last"] is not None:
        _add(session, f"{side}_iat", at - session[f"{side}_last"])
    elif packet["win"] is not None:
        session[f"{side}_win"] = packet["win"]
    session["last_us"] = session[f"{side}_last"] = at
    if packet["all_len"] is not None:
        _add(session, "all_len", packet["all_len"])
        _add(session, f"{side}_len", packet["all_len"])
    if packet["fwd_seg"] is not None:
        session["fwd_seg"] = packet["fwd_seg"] if session["fwd_seg"] is None else min(session["fwd_seg"], packet["fwd_seg"])
    for c in SUMS:
        session[c] += packet[c] or 0
    return session


class OrderedSessions(StatefulProcessor):
    """Sessions of one flow from packets in any order within the watermark's delay."""

    def __init__(self, idle_us: int, key: list[str]):
        self.idle_us, self.key = idle_us, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BUFFER)
        self.open = handle.getValueState("open", SESSION)

    def _wake(self, timers: object, at_us: int) -> None:
        """The flow's only timer, at the first millisecond not before ``at_us``."""
        now = timers.getCurrentWatermarkInMs()
        for old in list(self.handle.listTimers()):
            if old > now:  # the one that just expired goes by itself
                self.handle.deleteTimer(old)
        self.handle.registerTimer(max(-(-at_us // 1000), now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [tuple(r[c] for c in PACKET) for r in rows if r["ts_us"] > passed or passed <= 0]
        if fresh:
            self.waiting.appendList(fresh)
            first, known = min(p[0] for p in fresh), list(self.handle.listTimers())
            if not known or first <= min(known) * 1000:
                self._wake(timerValues, first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packets = sorted(map(tuple, self.waiting.get()), key=_place) if self.waiting.exists() else []
        ready = [p for p in packets if p[0] <= passed]
        held = self.open.get() if self.open.exists() else None
        session = None
        if held is not None:
            session = dict(zip(SESSION_FIELDS, held, strict=True))
            session.update({c: None if session[c] is None else int(session[c]) for c, kind in SESSION_FIELDS.items() if kind[0] == "d"})
        done = []
        for p in ready:
            packet = dict(zip(PACKET, p, strict=True))
            if session is not None and packet["ts_us"] - session["last_us"] >= self.idle_us:
                done.append(session)
                session = None
            session = take_packet(session, packet)
        if session is not None and session["last_us"] + self.idle_us <= passed:
            done.append(session)
            session = None
        rest = packets[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if session is None:
            self.open.clear()
        else:
            self.open.update(self._row(session))
        wake = [p[0] for p in rest[:1]] + ([session["last_us"] + self.idle_us] if session is not None else [])
        if wake:
            self._wake(timerValues, min(wake))
        for closed in done:
            yield Row(**dict(zip(self.key, key, strict=True)), **dict(zip(SESSION_FIELDS, self._row(closed), strict=True)))

    @staticmethod
    def _row(session: dict) -> tuple:
        return tuple(
            Decimal(session[c]) if kind[0] == "d" and session[c] is not None else session[c] for c, kind in SESSION_FIELDS.items()
        )

    def close(self) -> None:
        pass


def ordered_session_stream(packets: DataFrame, idle_seconds: int, delay: str) -> DataFrame:
    """STR4: flow records of a packet stream that close after an idle gap, all 88 columns.

    A gap of the idle length or more opens another session. Packets more than
    ``delay`` behind the newest one are dropped. The state needs RocksDB, which
    ``rocksdb_state`` gives to queries started inside it; every flow's packets meet in one task, whose
    state is one row and the packets of one delay.
    """
    rows = flow_measures(with_flow_key(packets.withWatermark("ts", delay))).withColumn(
        "win", F.when(F.col("proto") == 6, F.col("tcp_win")).cast("bigint")
    )
    work = rows.select(*FLOW_KEY, "ts", *(F.col(c).cast(kind).alias(c) for c, kind in PACKET.items()))
    schema = T.StructType([work.schema[c] for c in FLOW_KEY] + T._parse_datatype_string(SESSION).fields)
    closed = work.groupBy(*FLOW_KEY).transformWithState(
        OrderedSessions(idle_seconds * 1_000_000, FLOW_KEY), schema, outputMode="Append", timeMode="EventTime"
    )
    return flow_records(closed)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    before = spark.conf.get(STORE_CLASS)
    spark.conf.set(STORE_CLASS, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE_CLASS, before)


def ordered_sessions(packets: DataFrame, idle_seconds: int) -> DataFrame:
    """STR4 on a table: the same records from a batch of packets.

    (flow, bucket of the idle length) tells the session, as in
    ``flow_sessions``; the packets then go through the one-pass flow builder,
    which cuts even a flow of all packets into slices.
    """
    idle = idle_seconds * 1_000_000
    bucket = F.expr(f"floor(unix_micros(ts) / {idle}D)").alias("__b")
    keyed = with_flow_key(packets)
    spans = keyed.groupBy(*FLOW_KEY, bucket).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    keys = ", ".join(FLOW_KEY)
    opens = f"coalesce(a - lag(z) OVER (PARTITION BY {keys} ORDER BY __b) >= {idle}, true)"
    spans = spans.withColumn("__at", F.expr(f"if({opens}, a, NULL)"))
    spans = spans.withColumn("__opens", F.expr(f"last(__at, true) OVER (PARTITION BY {keys} ORDER BY __b)"))
    match = [keyed[c].eqNullSafe(F.col(f"__k_{c}")) for c in FLOW_KEY] + [F.expr(f"floor(ts_us / {idle}D)") == F.col("__b")]
    named = spans.select(*(F.col(c).alias(f"__k_{c}") for c in FLOW_KEY), "__b", "__opens")
    parted = keyed.join(named, match).withColumn("capture_id", F.struct("capture_id", "__opens")).select(*packets.columns)
    return build_flows(parted).withColumn("capture_id", F.col("capture_id.capture_id"))
