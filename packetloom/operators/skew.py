"""Ordered work inside groups of any size, by time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom.operators.sizing import small
from packetloom.session import ensure_checkpoint_dir

# Time one task sorts at once per group.
SLICE_US = 10_000_000
# A slice with too many rows is counted again in so many parts.
FINER = 1_000


def _at(df: DataFrame, cuts: DataFrame, keys: list[str], bucket: Column, how: str = "left") -> DataFrame:
    """Join ``cuts`` (keys, ``__b``, more) to the rows of the same keys and bucket; nulls meet nulls."""
    names = {c: f"__k{i}" for i, c in enumerate(keys)}
    side = small(cuts.withColumnsRenamed(names))
    same = bucket.eqNullSafe(side["__b"])
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(side[k])
    return df.join(side, same, how).drop(*names.values(), "__b")


def _divisor(width: int) -> int:
    """The widest bucket that cuts ``width`` into equal parts, a thousand of them or more."""
    return next(d for d in range(max(width // FINER, 1), 0, -1) if width % d == 0)


def _cuts(counts: DataFrame, keys: list[str], slice_rows: int, width: int) -> DataFrame:
    """Slices of about ``slice_rows`` rows from counts ``__c`` per bucket ``__b`` of ``width`` microseconds.

    Neighbouring buckets share a slice, named by its first bucket's start. A
    bucket that is too large alone (``__big``) is a slice of its own, and the
    buckets behind it start another one, so that slices follow each other in time.
    """
    time = W.partitionBy(*keys, "__s").orderBy("__b")
    big = F.col("__c") > slice_rows
    placed = (
        counts.withColumn("__big", big)
        .withColumn("__run", 2 * F.sum(F.col("__big").cast("bigint")).over(time) - F.col("__big").cast("bigint"))
        .withColumn("__part", F.floor((F.sum("__c").over(time) - F.col("__c")) / slice_rows))
    )
    first = F.min("__b").over(W.partitionBy(*keys, "__s", "__run", "__part"))
    return placed.withColumn("__start", first * width).drop("__run", "__part", "__s", "__c")


def sliced(
    df: DataFrame, keys: list[str], order_us: str, slice_us: int = SLICE_US, slice_rows: int | None = None,
    number: str | None = None,
) -> DataFrame:
    """``df`` with ``__slice``, an ordered value that cuts every group of ``keys`` into stretches of time.

    A slice covers ``slice_us`` microseconds. With ``slice_rows``, the rows per
    group and slice are counted first, from the keys and times alone. A slice
    with more rows is counted again in a thousand parts, neighbouring parts are
    joined to slices of fewer than twice ``slice_rows`` rows, and parts that are
    still too large are cut in the same way down to one microsecond. What shares
    a microsecond is cut by ``number``, the rows' running number and the second
    sort key, or stays together without one. Counts combine before the shuffle,
    so a burst passes one task neither here nor later. Null keys are a group.
    """
    cut = df.withColumn("__slice", F.expr(f"{order_us} div {int(slice_us)}L"))
    if slice_rows is None:
        return cut
    ensure_checkpoint_dir(df.sparkSession)
    width = int(slice_us)
    bucket = lambda w: F.expr(f"{order_us} div {w}L")
    work = df.withColumn("__slice", bucket(width) * width)
    large = F.col("__c") > slice_rows
    heavy = df.groupBy(*keys, bucket(width).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    heavy = heavy.where(large).select(*keys, "__b").checkpoint()
    found = not heavy.isEmpty()
    while found and width > 1:
        finer = _divisor(width)
        inside = _at(df.select(*keys, order_us), heavy.withColumn("__s", F.col("__b")), keys, bucket(width), "inner")
        counts = inside.groupBy(*keys, "__s", bucket(finer).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
        cuts = _cuts(counts, keys, slice_rows, finer).checkpoint()
        work = _at(work, cuts.drop("__big"), keys, bucket(finer))
        work = work.withColumn("__slice", F.coalesce("__start", "__slice")).drop("__start")
        heavy, width = cuts.where("__big").select(*keys, "__b"), finer
        found = not heavy.isEmpty()
    if found and number is not None:
        work = _at(work, heavy.withColumn("__tied", F.lit(True)), keys, F.col(order_us))
        part = F.when(F.col("__tied"), F.floor(F.col(number) / slice_rows)).otherwise(F.lit(0))
        work = work.withColumn("__slice", F.struct(F.col("__slice").alias("us"), part.alias("part"))).drop("__tied")
    return work


def lag_in_groups(
    df: DataFrame, keys: list[str], order_us: str, tiebreak: list[str], out: str, slice_us: int = SLICE_US,
    slice_rows: int | None = None,
) -> DataFrame:
    """Previous value of ``order_us`` inside each group.

    Every group is cut into time slices. Rows lag inside a slice; the first row
    of a slice takes the last value of the nearest earlier one, from a table of
    one row per group and slice. No group is sorted as a whole, and neither the
    width nor ``slice_rows`` (see ``sliced``) changes a result. Null keys are a group.
    """
    work = sliced(df, keys, order_us, slice_us, slice_rows)
    slice_keys = [*keys, "__slice"]
    order = [F.col(order_us), *[F.col(c) for c in tiebreak]]
    names = {c: f"__k{i}" for i, c in enumerate(slice_keys)}
    ends = work.groupBy(*[F.col(c).alias(k) for c, k in names.items()]).agg(F.max(order_us).alias("__end"))
    groups = W.partitionBy(*[names[c] for c in keys]).orderBy(names["__slice"])
    ends = ends.select(*names.values(), F.lag("__end").over(groups).alias("__before"))
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    inside = F.lag(order_us).over(W.partitionBy(*slice_keys).orderBy(*order))
    lagged = work.withColumn(out, inside).join(ends, same, "left")
    return lagged.withColumn(out, F.coalesce(F.col(out), F.col("__before"))).select(*df.columns, out)
