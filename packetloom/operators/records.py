"""Row-level contracts: standard output, error capture, array input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.numeric import parse_double, sanitize


def detection_output(df: DataFrame, metrics: list[str], timestamp: str = "ts") -> DataFrame:
    """PRJ22: the agreed output record over verdict, explanation and triggers."""
    return df.select(
        "source", "trace_id", F.col(timestamp).alias("timestamp"),
        F.col("fused_is_attack").alias("is_attack"),
        F.coalesce("fused_attack_type", F.lit("NORMAL")).alias("attack_type"),
        F.coalesce("fused_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("exp_severity", F.lit("low")).alias("severity"),
        F.coalesce("exp_summary", F.lit("")).alias("summary"),
        F.col("exp_recommendations").alias("recommendations"),
        F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("dynamic_metrics"),
        F.col("triggers").alias("rule_evidence"),
    )


def with_row_errors(df: DataFrame, numeric: list[str], out: str = "error") -> DataFrame:
    """PRJ23: a bad value marks its own row; the batch goes on.

    ``error`` names the first field holding text that is no number.
    """
    problems = [
        F.when(
            F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & parse_double(F.col(c)).isNull(),
            F.concat(F.lit(f"Invalid feature value: {c}="), F.col(c).cast("string")),
        )
        for c in numeric
    ]
    return df.withColumn(out, F.coalesce(*problems))


def features_from_array(df: DataFrame, array_col: str, columns: list[str], out: str = "error") -> DataFrame:
    """PRJ24: a value list becomes the fitted columns if its length fits."""
    n = len(columns)
    fits = F.size(array_col) == n
    text = F.concat(F.lit(f"Expected {n} raw features, got "), F.size(array_col).cast("string"))
    values = {c: F.when(fits, sanitize(F.get(F.col(array_col), F.lit(i)))) for i, c in enumerate(columns)}
    return df.withColumns({out: F.when(~fits, text), **values})


