"""Address text: canonical form, public test, client address from headers."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import constants as K

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# The same without the line end that "$" lets pass.
_V4_ONLY = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_GROUP_PATTERN = r"^[0-9a-f]{1,4}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` by name.

    Expressions that use an intermediate text many times would otherwise
    copy it into every use and grow beyond what the optimizer can handle.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _null_text() -> Column:
    return F.lit(None).cast("string")


def bare_address(c: Column) -> Column:
    """Strip quotes, port, brackets and zone; placeholders give null."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r'^"+|"+$', "")
    text = F.regexp_replace(text, r"^'+|'+$", "")

    def strip(t: Column) -> Column:
        placeholder = (t == "") | F.lower(t).isin("unknown", "null", "none")
        one_colon = t.rlike(r"^[^:]*:[^:]*$") & F.contains(t, F.lit("."))
        bare = (
            F.when(one_colon, F.trim(F.split_part(t, F.lit(":"), F.lit(1))))
            .when(t.rlike(r"^\[.*\]"), F.regexp_extract(t, r"^\[([^\]]*)\]", 1))
            .otherwise(t)
        )
        return F.when(placeholder, _null_text()).otherwise(F.split_part(bare, F.lit("%"), F.lit(1)))

    return _let(text, strip)


def v4_number(c: Column) -> Column:
    """Dotted text to BIGINT, null when it is not IPv4."""
    parts = F.split(F.when(c.rlike(V4_PATTERN), c), r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.cast("bigint"))


def _groups(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(text == "", empty).otherwise(F.split(text, ":"))


def v6_groups(c: Column) -> Column:
    """Eight lower-case hex groups of an IPv6 text, null when it is none."""

    def plain_tail(t: Column) -> Column:
        def as_groups(n: Column) -> Column:
            return F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536)))

        number = v4_number(F.regexp_extract(t, r":([0-9.]+)$", 1))
        hex_tail = F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+$", 1), _let(number, as_groups))
        return F.when(F.contains(t, F.lit(".")), hex_tail).otherwise(t)

    def expand(t: Column) -> Column:
        halves = F.array(
            _groups(F.split_part(t, F.lit("::"), F.lit(1))), _groups(F.split_part(t, F.lit("::"), F.lit(2)))
        )

        def fill(h: Column) -> Column:
            given = F.size(h[0]) + F.size(h[1])
            groups = F.concat(h[0], F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), h[1])
            well_formed = F.forall(F.flatten(h), lambda g: g.rlike(_GROUP_PATTERN))
            right_size = F.when(F.contains(t, F.lit("::")), given <= 7).otherwise(given == 8)
            return F.when(right_size & well_formed, groups)

        single_gap = ~t.rlike(r"::.*::") & ~F.contains(t, F.lit(":::"))
        return F.when(F.contains(t, F.lit(":")) & single_gap, _let(halves, fill))

    return _let(_let(F.lower(c), plain_tail), expand)


def v6_hex(c: Column) -> Column:
    """32 hex digits, ordered like the address."""
    return F.array_join(F.transform(v6_groups(c), lambda g: F.lpad(g, 4, "0")), "")


def v6_text(c: Column) -> Column:
    """Shortest IPv6 text: the leftmost longest run of zero groups collapses."""

    def shorten(plain: Column) -> Column:
        expr = plain
        for run in range(2, 9):
            pattern = rf"^(|.*?[^:]):?(?<![0-9a-f])0(?::0){{{run - 1}}}(?![0-9a-f])(?::(.*))?$"
            collapsed = F.concat(
                F.regexp_extract(plain, pattern, 1), F.lit("::"), F.regexp_extract(plain, pattern, 2)
            )
            expr = F.when(plain.rlike(pattern), collapsed).otherwise(expr)
        return expr

    trimmed = F.transform(v6_groups(c), lambda g: F.regexp_replace(g, r"^0+(?=.)", ""))
    return _let(F.array_join(trimmed, ":"), shorten)


def normalize_ip(c: Column) -> Column:
    """Canonical address text, null when the value is no address.

    A plain dotted address, the usual case, is its own canonical text.
    """
    cleaned = _let(
        bare_address(c),
        lambda t: F.when(t.rlike(V4_PATTERN), t).when(F.contains(t, F.lit(":")), v6_text(t)),
    )
    return F.when(c.rlike(_V4_ONLY), c).otherwise(cleaned)


def is_public_ip(c: Column) -> Column:
    """True for globally reachable addresses, from the special-purpose registries."""

    def hidden4(number: Column) -> Column:
        spans = [ipaddress.ip_network(block) for block in K.NON_PUBLIC_V4]
        inside = [number.between(int(n.network_address), int(n.broadcast_address)) for n in spans]
        return reduce(or_, inside)

    def hidden6(digits: Column) -> Column:
        spans = [ipaddress.ip_network(block) for block in K.NON_PUBLIC_V6]
        inside = [digits.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in spans]
        return reduce(or_, inside)

    return (
        F.when(c.rlike(V4_PATTERN), ~_let(v4_number(c), hidden4))
        .when(F.contains(c, F.lit(":")), ~_let(v6_hex(c), hidden6))
        .otherwise(F.lit(False))
    )


def client_ip(headers: Column, fallback: Column | None = None) -> Column:
    """First valid address of the proxy headers in priority order, else the host."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    found = []
    for name in K.CLIENT_IP_HEADERS:
        raw = lowered[name]
        if name == "x-forwarded-for":
            entries = F.split(raw, ",")
        elif name == "forwarded":
            parts = F.transform(F.split(raw, "[,;]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
            entries = F.transform(
                F.filter(parts, lambda p: p.rlike(r"(?i)^for=")), lambda p: F.regexp_replace(p, r"(?i)^for=\s*", "")
            )
        else:
            found.append(normalize_ip(raw))
            continue
        valid = F.filter(F.transform(entries, normalize_ip), lambda ip: ip.isNotNull())
        found.append(F.get(valid, F.lit(0)))
    if fallback is not None:
        found.append(normalize_ip(fallback))
    return F.coalesce(*found)


def inbound(c: Column) -> Column:
    """1 when the destination text lies in the monitored private prefixes."""
    return c.rlike(r"^(192\.168\.|172\.16\.|10\.)").cast("int")
