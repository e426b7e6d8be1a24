"""Cleaning, profiling, encoding and scaling of arbitrary flow tables.

``fit_*`` functions run jobs and return small per-column results; everything
else only builds plans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from packetloom import constants as K
from packetloom.functions.numeric import null_if_not_finite, parse_double
from packetloom.operators.sizing import dense_codes, small
from packetloom.session import ensure_checkpoint_dir

MISSING = "__missing__"
HISTOGRAM_BUCKETS = 4096
# Share of the rows on either side of the middle that the first bounds aim at.
MIDDLE_SHARE = 0.002


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean_columns(df: DataFrame) -> DataFrame:
    """PRJ1: trim column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def null_inf(df: DataFrame) -> DataFrame:
    """PRJ2: NaN and +-infinity in floating columns become null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_not_finite(_q(c)) for c in floats}) if floats else df


def resolve_label_column(columns: list[str], explicit: str | None = None) -> str:
    """SRC8: label column by candidate list, ignoring case and outer spaces."""
    by_key = {c.strip().lower(): c for c in columns}
    for candidate in [explicit] if explicit else K.LABEL_COLUMN_CANDIDATES:
        key = candidate.strip().lower()
        if key in by_key:
            return by_key[key]
    raise KeyError(f"no label column found (looked for {explicit or ', '.join(K.LABEL_COLUMN_CANDIDATES)})")


def feature_frame(df: DataFrame, label: str | None = None) -> DataFrame:
    """PRJ3: drop the label and unnamed index columns."""
    drop = [c for c in df.columns if c.strip().startswith("Unnamed:") or c == label]
    return df.drop(*drop)


@dataclass
class Profile:
    """Fitted preparation state, one entry per feature column in order."""

    columns: list[str]
    kinds: dict[str, str]
    fills: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    categories: DataFrame | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, i, self.kinds[c], self.fills.get(c), self.means.get(c), self.stds.get(c))
            for i, c in enumerate(self.columns)
        ]
        return spark.createDataFrame(
            rows, "column string, ordinal int, kind string, fill_value double, mean double, std double"
        )


def _is_time_name(name: str) -> bool:
    return "time" in name.strip().lower()


def as_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def profile_columns(df: DataFrame) -> DataFrame:
    """PRJ4: kind of every column from one aggregate pass.

    datetime: the name says time and some value parses; numeric: every
    non-null value casts; otherwise categorical.
    """
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = _q(f.name)
        parsed = F.count(as_timestamp(c)) if _is_time_name(f.name) and not isinstance(f.dataType, T.NumericType) else (
            F.lit(0).cast("bigint")
        )
        numeric = F.count(c) if isinstance(f.dataType, T.NumericType) else (
            F.lit(0).cast("bigint") if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType))
            else F.count(parse_double(c))
        )
        aggs += [F.count(c).alias(f"v{i}"), numeric.alias(f"n{i}"), parsed.alias(f"t{i}")]
    one = df.agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"), F.lit(i).alias("ordinal"), F.col(f"v{i}").alias("non_null"),
                F.col(f"n{i}").alias("numeric"), F.col(f"t{i}").alias("parsed"),
            )
            for i, name in enumerate(df.columns)
        ]
    )
    kind = (
        F.when(F.col("parsed") > 0, F.lit("datetime"))
        .when(F.col("numeric") == F.col("non_null"), F.lit("numeric"))
        .otherwise(F.lit("categorical"))
    )
    return one.select(F.inline(cells)).withColumn("kind", kind)


def fit_profile(df: DataFrame, exact_categories: bool = True) -> Profile:
    """Kinds, category codes and median fills of a feature frame."""
    rows = profile_columns(df).orderBy("ordinal").collect()  # one row per column
    profile = Profile([r["column"] for r in rows], {r["column"]: r["kind"] for r in rows})
    categorical = [c for c in profile.columns if profile.kinds[c] == "categorical"]
    if categorical:
        profile.categories = fit_categories(df, categorical)
    coded = encode(df, profile)
    profile.fills = fit_medians(coded, profile.columns)
    return profile


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def category_value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML1: alphabetical code per category of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), category_value(_q(c)).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).distinct()
    # Read once: every column's codes come from the pinned dictionary.
    return pinned(dense_codes(values, ["column"], "value"))


def apply_categories(df: DataFrame, categories: DataFrame, columns: list[str]) -> DataFrame:
    """ML1: codes in place of text, -1 for values unseen at fit."""
    for c in columns:
        codes = categories.where(F.col("column") == c).select(
            F.col("value").alias("__v"), F.col("code").cast("double").alias("__code")
        )
        df = (
            df.withColumn("__k", category_value(_q(c)))
            .join(small(codes), F.col("__k") == F.col("__v"), "left")
            .withColumn(c, F.coalesce(F.col("__code"), F.lit(-1.0)))
            .drop("__k", "__v", "__code")
        )
    return df


def epoch_ns(c: Column) -> Column:
    """PRJ5: timestamps (or their text) to epoch nanoseconds, bad text to null."""
    return (F.unix_micros(as_timestamp(c)) * F.lit(1000)).cast("double")


def align(df: DataFrame, profile: Profile, fill: float | None = None) -> DataFrame:
    """PRJ7/PRJ8: fitted columns in fitted order, others dropped.

    Missing columns turn into null (later imputed), or into ``fill`` together
    with every null and non-finite value in the scorer's variant.
    """
    cols = []
    for c in profile.columns:
        value = _q(c) if c in df.columns else F.lit(None).cast("string")
        if fill is not None:
            value = F.coalesce(null_if_not_finite(parse_double(value)), F.lit(float(fill)))
        cols.append(value.alias(c))
    return df.select(*cols)


def numeric_prefix(df: DataFrame, n: int, fill: float = 0.0) -> DataFrame:
    """PRJ8 without fitted names: the first ``n`` numeric columns, gaps filled."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)][:n]
    return df.select(*[F.coalesce(null_if_not_finite(_q(c).cast("double")), F.lit(fill)).alias(c) for c in names])


def encode(df: DataFrame, profile: Profile, keep: list[str] | None = None) -> DataFrame:
    """PRJ5-7, ML1: fitted columns as doubles, nulls still open.

    ``keep`` names further columns to carry along unchanged.
    """
    keep = list(keep or [])
    missing = [c for c in profile.columns if c not in df.columns]
    work = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    categorical = [c for c in profile.columns if profile.kinds[c] == "categorical"]
    if categorical:
        work = apply_categories(work, profile.categories, categorical)
    cols = []
    for c in profile.columns:
        if profile.kinds[c] == "datetime":
            value = epoch_ns(_q(c))
        elif profile.kinds[c] == "numeric":
            value = null_if_not_finite(parse_double(_q(c)))
        else:
            value = _q(c)
        cols.append(value.cast("double").alias(c))
    return work.select(*keep, *cols)


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """ML2: exact medians of all columns at once, 0 for empty columns.

    ``median()`` would keep every distinct value of a column in one task.
    Instead one pass of flat aggregates brings approximate bounds of the middle
    ranks, a second counts the values below and between them, and histograms of
    what lies between (a few thousandths of the rows) settle the rest: each
    such pass counts equal-width buckets for all open columns and brings back
    the one or two buckets of interest per column. The columns are parsed once
    and kept on the executors' disks for the later passes; what is lost with an
    executor is parsed again.
    """
    parsed = df.select(*[null_if_not_finite(_q(c).cast("double")).alias(c) for c in columns]).persist(StorageLevel.DISK_ONLY)
    try:
        return _medians(parsed, columns)
    finally:
        parsed.unpersist()


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    values = [_q(c) for c in columns]
    around = F.array(F.lit(0.5 - MIDDLE_SHARE), F.lit(0.5 + MIDDLE_SHARE))
    aggs = []
    for i, v in enumerate(values):
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, around, F.lit(int(10 / MIDDLE_SHARE))).alias(f"p{i}")]
    first = df.agg(*aggs).first()
    result: dict[str, float] = {}
    bounds: dict[int, tuple[float, float]] = {}
    for i, c in enumerate(columns):
        if first[f"n{i}"] == 0:
            result[c] = 0.0
        elif first[f"lo{i}"] == first[f"hi{i}"]:
            result[c] = first[f"lo{i}"]
        else:
            bounds[i] = tuple(first[f"p{i}"])
    open_cols: dict[str, tuple[float, float, int, int]] = {}  # lo, hi, lower rank, upper rank inside [lo, hi]
    counts = []
    for i, (low, high) in bounds.items():
        inside = F.when(values[i].between(low, high), values[i])
        counts += [F.count_if(values[i] < low).alias(f"b{i}"), F.count(inside).alias(f"c{i}"),
                   F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}")]
    second = df.agg(*counts).first() if counts else None
    for i in bounds:
        n, below, between = first[f"n{i}"], second[f"b{i}"], second[f"c{i}"]
        k1, k2 = (n - 1) // 2, n // 2
        if not (below <= k1 and k2 < below + between):
            open_cols[columns[i]] = (first[f"lo{i}"], first[f"hi{i}"], k1, k2)
        elif second[f"lo{i}"] == second[f"hi{i}"]:
            result[columns[i]] = second[f"lo{i}"]
        else:
            open_cols[columns[i]] = (second[f"lo{i}"], second[f"hi{i}"], k1 - below, k2 - below)
    while open_cols:
        open_cols = _narrow(df, open_cols, result)
    return {c: result[c] for c in columns}


def _narrow(
    df: DataFrame, state: dict[str, tuple[float, float, int, int]], result: dict[str, float]
) -> dict[str, tuple[float, float, int, int]]:
    names = list(state)
    top = HISTOGRAM_BUCKETS - 1
    cells = [
        F.struct(F.lit(i).alias("i"), _q(c).alias("v")) for i, c in enumerate(names)
    ]
    wanted = df.sparkSession.createDataFrame(
        [(i, *state[c]) for i, c in enumerate(names)], "i int, lo double, hi double, k1 bigint, k2 bigint"
    )
    # Halved operands keep the span of huge opposite-signed values finite.
    at = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    bucket = F.when(F.col("v") == F.col("hi"), F.lit(top)).otherwise(F.least(F.floor(at * top), F.lit(top - 1)).cast("int"))
    counts = (
        df.select(F.inline(F.array(*cells)))
        .join(F.broadcast(wanted), "i")
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy("i", bucket.alias("b"))
        .agg(F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    ranks = wanted.select("i", "k1", "k2")
    upto = F.expr("sum(c) OVER (PARTITION BY i ORDER BY b)")
    hits = (
        counts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("c"))
        .join(F.broadcast(ranks), "i")
        .where(
            F.col("k1").between(F.col("before"), F.col("upto") - 1)
            | F.col("k2").between(F.col("before"), F.col("upto") - 1)
        )
        .orderBy("i", "b")
        .collect()  # one or two buckets per column
    )
    still: dict[str, tuple[float, float, int, int]] = {}
    for i, c in enumerate(names):
        rows = [r for r in hits if r["i"] == i]
        _, _, k1, k2 = state[c]
        if len(rows) == 2:
            result[c] = (rows[0]["hi"] + rows[1]["lo"]) / 2
        elif rows[0]["lo"] == rows[0]["hi"]:
            result[c] = rows[0]["lo"]
        else:
            before = rows[0]["before"]
            still[c] = (rows[0]["lo"], rows[0]["hi"], k1 - before, k2 - before)
    return still


def apply_fill(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """ML2: medians in place of null."""
    return df.withColumns({c: F.coalesce(_q(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})


def fit_scaler(df: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """ML4: mean and population deviation; a constant column scales by 1."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    means = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    stds = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}
    return means, {c: (s if s > 0 and math.isfinite(s) else 1.0) for c, s in stds.items()}


def scale(df: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    return df.withColumns({c: (_q(c) - F.lit(means[c])) / F.lit(stds[c]) for c in means})


def encode_labels(df: DataFrame, label: str, out: str = "y") -> tuple[DataFrame, DataFrame]:
    """ML3: alphabetical dense label codes; numeric labels pass through.

    Returns (rows with a label and its code, the label table).
    """
    labelled = df.where(F.col(label).isNotNull())
    if isinstance(df.schema[label].dataType, T.NumericType):
        coded = labelled.withColumn(out, F.col(label).cast("bigint"))
        return coded, coded.select(F.col(label).cast("string").alias("label"), F.col(out).alias("code")).distinct()
    names = labelled.select(F.col(label).alias("label")).distinct()
    mapping = dense_codes(names, [], "label")
    key = mapping.select(F.col("label").alias(label), F.col("code").alias(out))
    return labelled.join(small(key), label), mapping


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """ML8: rows per class."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def check_two_classes(df: DataFrame, label: str) -> None:
    if label_distribution(df, label).limit(2).count() < 2:
        raise ValueError("training needs at least two classes")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """ML12: rows / (classes x class rows), from counts instead of a window
    over whole classes."""
    counts = label_distribution(df, label)
    every = W.partitionBy(F.lit(0))  # one row per class
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    weights = counts.select(label, (total / (classes * F.col("n"))).alias(out))
    return df.join(small(weights), label)


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """ML6: one-way F per feature from (n, sum, sum of squares) per class.

    All features share one aggregate per class; only that small result is
    unpivoted.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        v = _q(c).cast("double")
        aggs += [F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}")]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ordinal"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"))
            for i, c in enumerate(features)
        ]
    )
    long = per_class.select("n", F.inline(cells))
    sums = long.groupBy("feature", "ordinal").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
    )
    square = F.col("s") * F.col("s") / F.col("n")
    between = (F.col("b") - square) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return sums.select("feature", "ordinal", F.try_divide(between, within).alias("f_score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """ML7/WIN6: the k best features in column order; k <= 0 keeps all."""
    if k <= 0:
        return scores.orderBy("ordinal")
    return scores.orderBy(F.desc_nulls_last("f_score"), "ordinal").limit(k).orderBy("ordinal")


def union_files(frames: list[DataFrame]) -> DataFrame:
    """SET1: concatenate tables with differing columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
