"""Label, verdict and severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import constants as K


def normalize_label(c: Column) -> Column:
    """Trimmed upper-case label, blank gives null."""
    return F.nullif(F.upper(F.trim(c.cast("string"))), F.lit(""))


def is_attack_label(c: Column) -> Column:
    return ~F.lower(F.trim(c.cast("string"))).isin(*K.BENIGN_LABELS)


def normalize_attack_type(c: Column) -> Column:
    """Upper-case verdict without the detector suffix; anomalies count as DDOS."""
    text = F.replace(F.upper(F.trim(c)), F.lit("_DETECTION"), F.lit(""))
    return F.when(text == "ANOMALY", F.lit("DDOS")).otherwise(text)


def severity_by_cuts(confidence: Column, cuts: list[tuple[float, str]], fallback: Column) -> Column:
    expr = fallback
    for cut, name in reversed(cuts):
        expr = F.when(confidence >= cut, F.lit(name)).otherwise(expr)
    return expr


def event_severity(confidence: Column, attack: Column) -> Column:
    """Severity written on stored events."""
    graded = severity_by_cuts(confidence, K.EVENT_SEVERITY_CUTS, F.lit("low"))
    return F.when(~attack, F.lit("info")).otherwise(graded)


def explanation_severity(confidence: Column, catalogue_severity: Column) -> Column:
    """Severity shown in explanations; the catalogue's own below the cuts."""
    return severity_by_cuts(confidence, K.EXPLANATION_SEVERITY_CUTS, catalogue_severity)


def label_from_filename(c: Column, style: str = "flood") -> Column:
    """Label hinted by a file name.

    ``flood`` looks at the whole name and falls back to "normal"; ``replay``
    looks at the stem and falls back to the stem itself.
    """
    if style == "flood":
        name, words, expr = F.lower(c), K.FLOOD_FILE_LABELS, F.lit(K.FLOOD_FILE_DEFAULT)
    elif style == "replay":
        stem = file_stem(c)
        name, words, expr = F.lower(stem), K.REPLAY_FILE_LABELS, stem
    else:
        raise ValueError(f"unknown file label style: {style}")
    for word, label in reversed(words):
        expr = F.when(F.contains(name, F.lit(word)), F.lit(label)).otherwise(expr)
    return expr


def file_name(path: Column) -> Column:
    """Last component of a path written with either slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix (a leading dot is no suffix)."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
