"""Message templates and event ids."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(c: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, ties to even, as C printf does.

    ``scaled`` is c x 10^digits rounded to a double; ``rest`` is what that
    rounding lost (exact, from the split high and low halves of c), and it
    decides apparent ties such as 0.065.
    """
    power = F.lit(float(10**digits))
    scaled = c * power
    high = c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)
    rest = (high * power - scaled) + (c - high) * power
    whole = (
        F.when(scaled - F.floor(scaled) != 0.5, F.rint(scaled))
        .when(rest > 0, F.ceil(scaled).cast("double"))
        .when(rest < 0, F.floor(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )
    return F.format_string(f"%.{digits}f", whole / power)


def format_value(c: Column, spec: str) -> Column:
    if not spec:
        return F.coalesce(c.cast("string"), F.lit(""))
    if spec[0] != "." or not spec[1:-1].isdigit():
        raise ValueError(f"unsupported format: {spec}")
    digits = int(spec[1:-1])
    number = c.cast("double")
    if spec[-1] == "f":
        text = _fixed(number, digits)
    elif spec[-1] == "%":
        text = F.concat(_fixed(number * 100, digits), F.lit("%"))
    else:
        raise ValueError(f"unsupported format: {spec}")
    return F.coalesce(text, F.lit(""))


def template(text: str, fields: dict[str, Column]) -> Column:
    """Compile a brace template into one concat; unknown fields print nothing."""
    parts: list[Column] = []
    for literal, name, spec, _ in Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name is not None and name in fields:
            parts.append(format_value(fields[name], spec or ""))
    return F.concat(*parts) if parts else F.lit("")


def event_uid(*keys: Column) -> Column:
    """Sixteen hex characters derived from the event's own key, so replays agree."""
    return F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 16)
