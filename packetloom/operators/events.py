"""Detection event log: summaries, feeds, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom import constants as K
from packetloom.functions.labels import event_severity, is_attack_label
from packetloom.functions.numeric import safe_div
from packetloom.functions.text import event_uid, format_value, template


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def to_events(df: DataFrame, uid_keys: list[str] | None = None) -> DataFrame:
    """Verdict and severity columns of stored events; TXT6 ids where missing."""
    attack = is_attack_label(F.col("prediction_label"))
    out = df.withColumn("is_attack", attack)
    out = out.withColumn("severity", event_severity(F.col("confidence"), F.col("is_attack")))
    if "event_uid" not in out.columns:
        out = out.withColumn("event_uid", event_uid(*[F.col(k) for k in uid_keys or []]))
    return out


def _by_label_and_source(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.col("prediction_label").alias("label"), F.coalesce("source", F.lit("unknown")).alias("source")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("attacks"))


def event_counters(events: DataFrame) -> DataFrame:
    """AGG2: counts per label, per source and overall from one scan."""
    base = _by_label_and_source(events)
    sets = [[F.col("label")], [F.col("source")], []]
    kind = F.when(F.col("gl") == 0, F.lit("label")).when(F.col("gs") == 0, F.lit("source")).otherwise(F.lit("total"))
    return (
        base.groupingSets(sets, "label", "source")
        .agg(
            F.sum("n").alias("n"), F.sum("attacks").alias("attacks"),
            F.grouping("label").alias("gl"), F.grouping("source").alias("gs"),
        )
        .select(kind.alias("kind"), F.coalesce("label", "source").alias("key"), "n", "attacks")
    )


def last_event(events: DataFrame) -> DataFrame:
    """Newest event by (time, id): a top-1, not a sort."""
    return events.orderBy(F.desc("ts"), F.desc("event_uid")).limit(1)


def event_summary(events: DataFrame, top: int | None = None) -> DataFrame:
    """AGG1: one row of totals, label and source maps, and the last event.

    With ``top`` the maps hold that many keys with the most events (ties by
    key), and ``other_label_events`` and ``other_source_events`` say how many
    events the rest have, so the row stays small however many sources there
    are; ``event_counters`` has every key as a row. The top keys are found by
    a rank that Spark prunes in every task, not by sorting all keys.
    """
    counters = event_counters(events)
    if top is not None:
        rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), F.asc("key")))
        counters = counters.withColumn("__rank", rank).where(F.col("__rank") <= top).drop("__rank")

    def counts_of(kind: str) -> Column:
        pair = F.when(F.col("kind") == kind, F.struct(F.coalesce("key", F.lit("")).alias("key"), "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))

    pick = lambda name: F.coalesce(F.max(F.when(F.col("kind") == "total", F.col(name))), F.lit(0))
    shown = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    others = [] if top is None else [(pick("n") - shown(k)).alias(f"other_{k}_events") for k in ("label", "source")]
    totals = counters.agg(
        pick("n").alias("total_events"), pick("attacks").alias("attack_events"),
        counts_of("label").alias("labels"), counts_of("source").alias("sources"), *others,
    )
    newest = last_event(events).select(F.struct("*").alias("last_event"), F.lit(1).alias("__one"))
    return (
        totals.withColumn("__one", F.lit(1))
        .join(F.broadcast(newest), "__one", "left")
        .select(
            "total_events", "attack_events",
            (F.col("total_events") - F.col("attack_events")).alias("benign_events"),
            safe_div(F.col("attack_events"), F.col("total_events")).alias("attack_ratio"),
            "labels", "sources", *(["other_label_events", "other_source_events"] if others else []), "last_event",
        )
    )


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """WIN2: the newest n events, oldest first."""
    return last_n(events, n).orderBy("ts", "event_uid")


def last_n(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_uid")).limit(n)


def cursor_of(ts: Column, uid: Column) -> Column:
    return F.concat(iso_time(ts), F.lit("|"), uid)


def events_delta(events: DataFrame, cursor: str | None, limit: int, keep: str = "first") -> DataFrame:
    """WIN3: events after a ``<time>|<id>`` cursor, each with its own cursor.

    ``keep="first"`` returns the oldest after the cursor, so a slow reader
    loses nothing; ``keep="last"`` jumps to the newest. Without a cursor the
    newest events are returned.
    """
    after = events
    if cursor:
        since, _, uid = cursor.partition("|")
        moment = F.to_timestamp(F.lit(since))
        after = events.where((F.col("ts") > moment) | ((F.col("ts") == moment) & (F.col("event_uid") > uid)))
    if cursor and keep == "first":
        picked = after.orderBy("ts", "event_uid").limit(limit)
    else:
        picked = last_n(after, limit)
    return picked.withColumn("cursor", cursor_of(F.col("ts"), F.col("event_uid")))


def next_cursor(delta: DataFrame, cursor: str) -> DataFrame:
    """Cursor to continue from: the greatest one read, else the old one."""
    newest = F.max(F.struct("ts", "event_uid"))
    value = F.when(newest.isNotNull(), cursor_of(newest["ts"], newest["event_uid"])).otherwise(F.lit(cursor))
    return delta.agg(value.alias("cursor"))


def timeline(events: DataFrame) -> DataFrame:
    """SNK2: rows of the attack timeline file."""
    return events.select(
        iso_time(F.col("ts")).alias("timestamp"), "prediction_label",
        format_value(F.col("confidence"), ".6f").alias("confidence"),
        F.col("is_attack").cast("int").alias("is_attack"), "severity",
        F.coalesce("source", F.lit("unknown")).alias("source"),
    )


def batch_alerts(events: DataFrame) -> DataFrame:
    """AGG12: roll-up per source; sources without an attack send none."""
    return (
        events.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("total_events"), F.count_if("is_attack").alias("attack_events"),
            F.max("ts").alias("timestamp"),
        )
        .where(F.col("attack_events") > 0)
        .withColumns(
            {
                "benign_events": F.col("total_events") - F.col("attack_events"),
                "attack_ratio": F.col("attack_events") / F.col("total_events"),
            }
        )
    )


def alert_context(events: DataFrame) -> DataFrame:
    """TXT5: one context row per attack event, gaps filled."""
    has = lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    blank = lambda c: F.nullif(c, F.lit(""))
    return attack_events(events).select(
        "event_uid",
        iso_time(F.col("ts")).alias("timestamp"),
        F.coalesce(blank(has("attack_type")), blank(F.col("prediction_label")), F.lit("UNKNOWN")).alias("attack_type"),
        F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "source", "input_kind",
        F.coalesce(blank(has("exp_summary")), blank(has("summary")), F.lit(K.DEFAULT_ALERT_SUMMARY)).alias("summary"),
    )


def alert_messages(context: DataFrame, text: str = K.ALERT_TEMPLATES["detection"]) -> DataFrame:
    """TXT4: message per context row from a brace template."""
    fields = {c: F.col(c) for c in context.columns}
    return context.withColumn("message", template(text, fields))


def batch_messages(alerts: DataFrame, text: str = K.ALERT_TEMPLATES["batch"]) -> DataFrame:
    return alert_messages(alerts.withColumn("timestamp", iso_time(F.col("timestamp"))), text)


def attack_events(events: DataFrame) -> DataFrame:
    """JON7: attack events only."""
    return events.where("is_attack")


def with_any_attack(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """JON7: rows whose key has at least one attack event."""
    keys = attack_events(events).select(key).distinct()
    return rows.join(keys, key, "left_semi")


def tally(rows: DataFrame, predicted: str, given: str, file_col: str, attack: str) -> DataFrame:
    """AGG13: totals, per predicted label, per input label and per file."""
    base = rows.groupBy(
        F.coalesce(predicted, F.lit("unknown")).alias("p"), F.coalesce(given, F.lit("unknown")).alias("g"),
        F.coalesce(file_col, F.lit("unknown")).alias("f"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(attack)).alias("a"))
    sets = [[F.col("p")], [F.col("g")], [F.col("f")], []]
    level = F.grouping_id()
    kind = (
        F.when(F.col("level") == 3, F.lit("predicted")).when(F.col("level") == 5, F.lit("input"))
        .when(F.col("level") == 6, F.lit("file")).otherwise(F.lit("total"))
    )
    return (
        base.groupingSets(sets, "p", "g", "f")
        .agg(F.sum("n").alias("n"), F.sum("a").alias("attacks"), level.alias("level"))
        .select(kind.alias("kind"), F.coalesce("p", "g", "f").alias("key"), "n", "attacks")
    )
