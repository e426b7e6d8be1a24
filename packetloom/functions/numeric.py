"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.constants import MAX_ABS_INPUT

INF = float("inf")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0 or either side is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def null_if_not_finite(c: Column) -> Column:
    """NaN and +-infinity become null (NaN sorts above infinity)."""
    return F.when(F.abs(c) < F.lit(INF), c)


NUMBER_TEXT = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def parse_double(c: Column) -> Column:
    """Text to double, null when it is no number.

    The pattern keeps out what only the JVM parser takes ("12d", hex floats)
    and spares it the costly failures on ordinary words.
    """
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def finite(c: Column) -> Column:
    """Text or number to a finite double; blank, bad and non-finite give null."""
    return null_if_not_finite(parse_double(c))


def sanitize(c: Column, max_abs: float = MAX_ABS_INPUT) -> Column:
    """NaN (and null) to 0, then clip into [-max_abs, max_abs]."""
    value = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(-max_abs)), F.lit(max_abs))


def rate_input(c: Column) -> Column:
    """Rule input: anything that is not a plain number counts as 0."""
    return F.coalesce(F.nanvl(parse_double(c), F.lit(0.0)), F.lit(0.0))


def coerce_float_map(m: Column) -> Column:
    """Map of text to map of double, dropping what is no number."""
    return F.map_filter(F.transform_values(m, lambda _, v: parse_double(v)), lambda _, v: v.isNotNull())


def compact_map(m: Column) -> Column:
    """Drop null and empty fields of a record."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def whole_text(c: Column) -> Column:
    """Number as text without decimals, ties to even."""
    whole = F.rint(c)
    return F.coalesce(
        whole.try_cast("bigint").cast("string"), whole.try_cast("decimal(38,0)").cast("string"), F.lit("inf")
    )
