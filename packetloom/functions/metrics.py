"""Packet length, SYN and UDP metrics looked up by alias names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import constants as K
from packetloom.functions.numeric import finite


def normalize_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def _plain_key(name: str) -> str:
    return re.sub(r"[\W_]", "", name.lower())


def _first(lookup: Callable[[str], Column], aliases: list[str]) -> Column:
    keys = dict.fromkeys(_plain_key(alias) for alias in aliases)
    return F.coalesce(*[lookup(key) for key in keys])


def _at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def metric_columns(lookup: Callable[[str], Column], udp_per_minute: bool = False) -> dict[str, Column]:
    """pkt_len / syn_count / udp_count from a key -> finite double lookup.

    A SYN flag count without an explicit rate becomes a per-second rate; TCP
    and UDP records without any count fall back to the flow packet rate.
    """
    pkt_len = F.coalesce(_first(lookup, K.METRIC_ALIASES["pkt_len"]), F.lit(0.0))
    syn_alias = F.coalesce(_first(lookup, K.METRIC_ALIASES["syn_count"]), F.lit(0.0))
    udp_alias = F.coalesce(_first(lookup, K.METRIC_ALIASES["udp_count"]), F.lit(0.0))

    rate = lookup(_plain_key("Flow Packets/s"))
    duration = lookup(_plain_key("Flow Duration"))
    flags = lookup(_plain_key("SYN Flag Count"))
    protocol = lookup(_plain_key("Protocol"))
    explicit = _first(lookup, K.SYN_RATE_ALIASES)

    derived = (
        F.when(duration > 0, flags / (duration / F.lit(1e6)))
        .when(rate.isNotNull(), flags * rate)
        .otherwise(flags)
    )
    syn = F.when(explicit.isNull() & flags.isNotNull(), _at_least_zero(derived)).otherwise(syn_alias)
    tcp_fallback = explicit.isNull() & (syn <= 0) & (protocol == 6) & rate.isNotNull()
    syn = F.when(tcp_fallback, _at_least_zero(rate)).otherwise(syn)

    udp_rate = _at_least_zero(rate * F.lit(60.0 if udp_per_minute else 1.0))
    udp = F.when((udp_alias == 0) & (protocol == 17) & rate.isNotNull(), udp_rate).otherwise(udp_alias)
    return {"pkt_len": pkt_len, "syn_count": syn, "udp_count": udp}


METRIC_KEYS = list(
    dict.fromkeys(
        _plain_key(name)
        for name in [
            *[alias for aliases in K.METRIC_ALIASES.values() for alias in aliases],
            *K.SYN_RATE_ALIASES, "Flow Packets/s", "Flow Duration", "SYN Flag Count", "Protocol",
        ]
    )
)


def _staged(df: DataFrame, values: dict[str, Column], udp_per_minute: bool) -> DataFrame:
    """Look every key up once, then derive the metrics from plain columns."""
    work = df.withColumns({f"__m_{key}": value for key, value in values.items()})

    def lookup(key: str) -> Column:
        return F.col(f"__m_{key}") if key in values else F.lit(None).cast("double")

    return work.withColumns(metric_columns(lookup, udp_per_minute)).drop(*[f"__m_{key}" for key in values])


def dynamic_metrics_from_map(
    df: DataFrame, record: str, features: str | None = None, udp_per_minute: bool = False
) -> DataFrame:
    """Metrics of a free-form record column, the record preferred to the features."""
    source = F.coalesce(F.col(record), F.col(features)) if features else F.col(record)
    # Keys that name no metric go first, so each value left is parsed once, whatever the number of look-ups.
    named = F.map_filter(F.transform_keys(source, lambda k, _: normalize_key(k)), lambda k, _: k.isin(METRIC_KEYS))
    work = df.withColumn("__metric_map", F.transform_values(named, lambda _, v: finite(v)))
    # Unlike a subscript, this look-up is not copied into every expression that uses it.
    values = {key: F.try_element_at("__metric_map", F.lit(key)) for key in METRIC_KEYS}
    return _staged(work, values, udp_per_minute).drop("__metric_map")


def dynamic_metrics(df: DataFrame, udp_per_minute: bool = False) -> DataFrame:
    """Metrics of typed columns; aliases resolve against the schema."""
    by_key = {_plain_key(name): name for name in df.columns}
    values = {key: finite(F.col(f"`{by_key[key]}`")) for key in METRIC_KEYS if key in by_key}
    return _staged(df, values, udp_per_minute)
