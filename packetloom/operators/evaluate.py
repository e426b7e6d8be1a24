"""Evaluation of scored rows from one small confusion table.

Data rows are read once, into counts per (file, true, predicted); every
metric is arithmetic on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom.functions.labels import normalize_label
from packetloom.functions.numeric import safe_div

MAX_LABELS = 2_000


def scored_counts(
    df: DataFrame, file_col: str = "source_file", true: str = "y_true", pred: str = "y_pred", conf: str = "confidence"
) -> DataFrame:
    """Counts and confidence partials per file and label pair; unlabelled rows drop out."""
    rows = df.select(
        F.col(file_col).alias("source_file"),
        normalize_label(F.col(true)).alias("y_true"),
        F.coalesce(normalize_label(F.col(pred)), F.lit("")).alias("y_pred"),
        F.col(conf).cast("double").alias("c"),
    ).where(F.col("y_true").isNotNull())
    return rows.groupBy("source_file", "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("conf_sum"),
        F.min("c").alias("conf_min"), F.max("c").alias("conf_max"),
    )


def confusion_counts(counts: DataFrame) -> DataFrame:
    """AGG3: label pairs per file and overall (file null)."""
    sets = [[F.col("source_file"), F.col("y_true"), F.col("y_pred")], [F.col("y_true"), F.col("y_pred")]]
    return (
        counts.groupingSets(sets, "source_file", "y_true", "y_pred")
        .agg(F.sum("n").alias("n"), F.grouping("source_file").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.lit("file")).alias("level"),
                "source_file", "y_true", "y_pred", "n")
    )


def running_stats(counts: DataFrame) -> DataFrame:
    """AGG4: rows, accuracy, confidence and class counts per file and overall."""
    return (
        counts.groupingSets([[F.col("source_file")], []], "source_file")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("correct"),
            F.sum("conf_sum").alias("conf_sum"),
            F.min("conf_min").alias("confidence_min"),
            F.max("conf_max").alias("confidence_max"),
            F.count_distinct("y_true").alias("true_classes"),
            F.count_distinct("y_pred").alias("pred_classes"),
            F.grouping("source_file").alias("g"),
        )
        .select(
            F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.lit("file")).alias("level"),
            "source_file", "rows", "correct",
            safe_div(F.col("correct"), F.col("rows")).alias("accuracy"),
            safe_div(F.col("conf_sum"), F.col("rows")).alias("confidence_mean"),
            "confidence_min", "confidence_max", "true_classes", "pred_classes",
        )
    )


def file_scores(counts: DataFrame) -> DataFrame:
    """AGG4: precision, recall and F1 per file, weighted by the true rows of each label."""
    true = counts.groupBy("source_file", F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"),
        F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("tp"),
    )
    predicted = counts.groupBy("source_file", F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    keyed = predicted.select(F.col("source_file").alias("__f"), F.col("label").alias("__l"), "predicted")
    # Labels nobody predicts have precision 0; a file may be null like any group.
    same = F.col("source_file").eqNullSafe(F.col("__f")) & (F.col("label") == F.col("__l"))
    precision = F.coalesce(safe_div(F.col("tp"), F.col("predicted")), F.lit(0.0))
    scored = true.join(keyed, same, "left").select(
        "source_file", "support", precision.alias("p"), safe_div(F.col("tp"), F.col("support")).alias("r")
    )
    weighted = lambda c: safe_div(F.sum(c * F.col("support")), F.sum("support"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return scored.groupBy("source_file").agg(
        weighted(F.col("p")).alias("precision_weighted"), weighted(F.col("r")).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
    )


def overall_pairs(counts: DataFrame) -> DataFrame:
    return counts.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def observed_labels(pairs: DataFrame) -> DataFrame:
    """SET2: union of true and predicted labels, blanks dropped."""
    labels = pairs.select(F.col("y_true").alias("label")).union(pairs.select("y_pred")).distinct()
    return labels.where(F.col("label") != "")


def label_universe(pairs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """AGG10: model labels by code, then other observed labels alphabetically."""
    labels = observed_labels(pairs)
    if mapping is not None:
        known = mapping.select(normalize_label(F.col("label")).alias("label"), F.col("code").cast("bigint"))
        known = known.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("code").alias("code"))
        labels = labels.join(known, "label", "full")
    else:
        labels = labels.withColumn("code", F.lit(None).cast("bigint"))
    order = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("code"), "label")  # one row per class
    return labels.withColumn("ordinal", F.row_number().over(order) - 1)


def label_list(universe: DataFrame) -> list[str]:
    """Class names in order. Their number is checked: a matrix has its square."""
    rows = universe.orderBy("ordinal").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} classes")
    return [r["label"] for r in rows]


def dense_confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """JON5: every label pair, 0 where nothing was counted.

    Rows are spelled out from the checked label list and joined by key.
    """
    names = F.array(*[F.lit(x) for x in labels])
    grid = pairs.sparkSession.range(1).select(F.explode(names).alias("y_true"))
    grid = grid.select("y_true", F.explode(names).alias("y_pred"))
    return grid.join(pairs, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def row_normalised(dense: DataFrame) -> DataFrame:
    """AGG7: share within the true class, 0 for classes without rows."""
    total = F.sum("n").over(W.partitionBy("y_true"))
    return dense.withColumn("share", safe_div(F.col("n"), total))


def wide_confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """AGG8: one row per true label, one column per predicted label."""
    wide = dense_confusion(pairs, labels).groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))
    return wide.select("y_true", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels])


def per_class(pairs: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """AGG5: precision, recall, F1 and counts per class, 0 on empty denominators."""
    zero = F.lit(0).cast("bigint")
    n = F.col("n").cast("bigint")
    as_true = pairs.select(
        F.col("y_true").alias("label"), n.alias("support"), zero.alias("predicted"),
        F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero).alias("tp"),
    )
    as_pred = pairs.select(F.col("y_pred").alias("label"), zero, n, zero)
    rows = as_true.union(as_pred)
    if universe is not None:
        rows = rows.union(universe.select("label", zero, zero, zero))
    sums = rows.where(F.col("label") != "").groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("true_positive")
    )
    precision = safe_div(F.col("true_positive"), F.col("predicted"))
    recall = safe_div(F.col("true_positive"), F.col("support"))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    f1 = safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("label", "precision", "recall", f1.alias("f1"), "support", "predicted", "true_positive")


def overall_metrics(classes: DataFrame) -> DataFrame:
    """AGG6: accuracy, weighted and macro averages; all 0 without rows.

    Classes without support count in the macro averages.
    """
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.coalesce(safe_div(F.sum(F.col(name) * F.col("support")), total), F.lit(0.0)).alias(f"{name}_weighted")

    def macro(name: str) -> Column:
        return F.when(total > 0, F.avg(name)).otherwise(F.lit(0.0)).alias(f"{name}_macro")

    names = ("precision", "recall", "f1")
    return classes.agg(
        safe_div(F.sum("true_positive"), total).alias("accuracy"),
        *[weighted(x) for x in names],
        *[macro(x) for x in names],
        F.coalesce(total, F.lit(0)).alias("support"),
    ).withColumn("balanced_accuracy", F.col("recall_macro"))


def class_distribution(classes: DataFrame) -> DataFrame:
    """AGG9: rows per class, true against predicted."""
    return classes.select("label", F.col("support").alias("true_count"), F.col("predicted").alias("pred_count"))


def unmatched_labels(classes: DataFrame) -> DataFrame:
    """SET3: classes never predicted or never seen."""
    return classes.where((F.col("support") == 0) | (F.col("predicted") == 0)).select(
        "label", (F.col("support") == 0).alias("never_seen"), (F.col("predicted") == 0).alias("never_predicted")
    )


def file_ranking(stats: DataFrame) -> DataFrame:
    """AGG11: files by accuracy, then size, then name."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), F.desc("rows"), "source_file")  # one row per file
    return stats.where(F.col("level") == "file").withColumn("rank", F.row_number().over(order))
