"""Size-checked broadcasts and distributed dense codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom.session import ensure_checkpoint_dir

BROADCAST_ROWS = 200_000
LOCAL_CODES = 1_000_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Bounded check: at most ``rows`` + 1 rows are looked at after the aggregate."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Dimension table for a join: pinned and broadcast if its size allows.

    At most ``rows`` + 1 rows are fetched to check the size. Within the bound
    the fetched rows themselves become the broadcast side, so the table is not
    computed again; beyond it the join is a plain shuffle, where adaptive
    execution splits skewed keys.
    """
    fetched = df.limit(rows + 1).toArrow()
    if fetched.num_rows > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, df.schema))


def dense_codes(
    distinct_values: DataFrame, group: list[str], value: str, code: str = "code", local_rows: int = LOCAL_CODES
) -> DataFrame:
    """0-based alphabetical code per group for already distinct values.

    Few values: one window per group. Many values: range-partitioned sort, a
    reliable checkpoint to pin the partition numbers, then per-partition
    offsets (one row per partition and group) plus a rank inside the partition.
    """
    if has_at_most(distinct_values, local_rows):
        order = W.partitionBy(*group).orderBy(value) if group else W.partitionBy(F.lit(0)).orderBy(value)
        return distinct_values.withColumn(code, (F.row_number().over(order) - 1).cast("bigint"))
    ensure_checkpoint_dir(distinct_values.sparkSession)
    parts = (
        distinct_values.repartitionByRange(*group, value)
        .withColumn("__pid", F.spark_partition_id())
        .checkpoint()
    )
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    offsets = (
        parts.groupBy(*group, "__pid")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(earlier.orderBy("__pid")) - F.col("__n"))
        .drop("__n")
    )
    inside = W.partitionBy(*group, "__pid").orderBy(value)
    return (
        parts.join(F.broadcast(offsets), [*group, "__pid"])
        .withColumn(code, (F.col("__before") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("__pid", "__before")
    )
