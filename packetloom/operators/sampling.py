"""Exact per-group selection in a seeded hash order.

Row order of files has no counterpart in a distributed table, so order is the
md5 of a seed and the key columns. The hash prefix gives evenly filled
buckets: counts per (group, bucket) tell which buckets are wanted as a whole,
and only the one bucket at the cut needs a rank, or a finer count if it is
large. No group is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packetloom.operators.sizing import small
from packetloom.session import ensure_checkpoint_dir

# Largest n that Spark's group limit prunes before the shuffle (see session.py).
PRUNED_N = 1_000
# Rows of one bucket that a task may rank; larger ones are counted by more digits.
EDGE_ROWS = 100_000
# Hex digits counted at a time, and those of the order hash and of the row hash behind it.
DIGITS, HASH_DIGITS, ROW_DIGITS = 4, 32, 16


def _left_null_safe(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on ``by`` where a null key meets a null key; the keys come from the left."""
    names = {c: f"__k{i}" for i, c in enumerate(by)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    return left.join(renamed, same, "left").drop(*names.values())


def order_hash(seed: str | int, keys: list[str]) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _counted(work: DataFrame, by: list[str], digits: Column) -> DataFrame:
    return work.groupBy(*by, digits.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))


def _cut_buckets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group the bucket ``__b`` of ``__c`` rows that holds its ``__want``-th row.

    Returns the group, ``__cut`` (hash prefix of the bucket), ``__need`` (rows
    wanted of it) and ``__size`` (its rows). A group with fewer rows has none.
    """
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy("__b"))
    return (
        counts.withColumn("__upto", upto)
        .where(F.col("__upto") >= F.col("__want"))
        .groupBy(*by)
        .agg(
            F.min("__b").alias("__cut"),
            F.min_by(F.col("__want") - F.col("__upto") + F.col("__c"), "__b").alias("__need"),
            F.min_by("__c", "__b").alias("__size"),
        )
    )


def _held(cut: DataFrame) -> DataFrame:
    """One row per group, computed once and broadcast within the bound."""
    ensure_checkpoint_dir(cut.sparkSession)
    return small(cut.checkpoint())


def mark_per_group(
    df: DataFrame, group: list[str], keys: list[str], n: int | DataFrame, seed: str | int = 0, out: str = "taken",
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """Flag the first ``n`` rows of every group in hash order.

    ``n`` is a number or a table (group columns, ``n``); a group absent from
    the table gets none. ``group=[]`` selects over the whole table. Null keys
    form a group of their own.

    A bucket at the cut with more than ``edge_rows`` rows is counted again by
    its next hash digits, so no task ranks more than that, however large a
    group is. Rows that repeat the same keys have the same hash; a hash of the
    whole row parts them. Only rows alike in every column (maps aside) stay
    together, and of those any will do.
    """
    work = df.withColumn("__h", order_hash(seed, keys))
    by = list(group)
    if not by:
        work, by = work.withColumn("__all", F.lit(0)), ["__all"]
    counts = _counted(work, by, F.substring("__h", 1, DIGITS))
    if isinstance(n, DataFrame):
        counts = _left_null_safe(counts, n.select(*by, F.col("n").cast("bigint").alias("__want")), by).fillna(0, ["__want"])
    else:
        counts = counts.withColumn("__want", F.lit(int(n)).cast("bigint"))
    cut = _held(_cut_buckets(counts, by))
    length, wide = DIGITS, (F.col("__size") > edge_rows) & F.col("__need").between(1, F.col("__size") - 1)
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    while length < HASH_DIGITS + ROW_DIGITS and not cut.where(wide).isEmpty():
        if length == HASH_DIGITS:
            work = work.withColumn("__h", F.concat("__h", F.lpad(F.hex(F.xxhash64(*plain)), ROW_DIGITS, "0")))
        inside = _left_null_safe(work, cut.where(wide), by).where(F.col("__h").startswith(F.col("__cut")))
        finer = F.concat("__cut", F.substring("__h", length + 1, DIGITS))
        narrowed = _counted(inside, [*by, "__need"], finer).withColumnRenamed("__need", "__want")
        cut = _held(cut.where(~wide).unionByName(_cut_buckets(narrowed, by)))
        length += DIGITS
    joined = _left_null_safe(work, cut, by)
    at_cut = F.coalesce(F.col("__h").startswith(F.col("__cut")) & F.col("__need").between(1, F.col("__size") - 1), F.lit(False))
    # A whole bucket at the cut is taken or left without a rank.
    whole = F.col("__h").startswith(F.col("__cut")) & (F.col("__need") >= F.col("__size"))
    clear = joined.where(~at_cut).withColumn(
        out, F.col("__cut").isNull() | whole | (~F.col("__h").startswith(F.col("__cut")) & (F.col("__h") < F.col("__cut")))
    )
    rank = F.row_number().over(W.partitionBy(*by).orderBy("__h", *keys))
    edge = joined.where(at_cut).withColumn(out, rank <= F.col("__need"))
    return clear.unionByName(edge).select(*df.columns, out)


def take_per_group(
    df: DataFrame, group: list[str], keys: list[str], n: int | DataFrame, seed: str | int = 0
) -> DataFrame:
    """The first ``n`` rows of every group in hash order; null keys are a group like any other.

    For a small fixed ``n`` the rank filter goes below the shuffle: every task
    forwards at most ``n`` rows per group. The rows are the same either way.
    """
    if group and not isinstance(n, DataFrame) and n <= PRUNED_N:
        rank = F.row_number().over(W.partitionBy(*group).orderBy("__h", *keys))
        return df.withColumn("__h", order_hash(seed, keys)).withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__h", "__rn")
    return mark_per_group(df, group, keys, n, seed, "__taken").where("__taken").drop("__taken")


def _file_counts(df: DataFrame, file_col: str) -> DataFrame:
    return df.groupBy(file_col).agg(F.count(F.lit(1)).alias("rows"))


def _running_quota(counts: DataFrame, file_col: str, per_file: Column, total: int) -> DataFrame:
    """Rows to take per file when files are read in name order up to a total.

    The window runs over one row per file, never over data rows.
    """
    order = W.partitionBy(F.lit(0)).orderBy(file_col).rowsBetween(W.unboundedPreceding, -1)
    capped = counts.withColumn("__c", F.least(F.col("rows"), per_file))
    before = F.coalesce(F.sum("__c").over(order), F.lit(0))
    return capped.withColumn("__before", before).withColumn(
        "n", F.greatest(F.lit(0), F.least(F.col("__c"), F.lit(total) - F.col("__before"))).cast("bigint")
    )


def cap_rows_per_file(
    df: DataFrame, file_col: str, keys: list[str], max_rows: int | None, max_files: int | None = None
) -> DataFrame:
    """SRC3: the first files by name and at most ``max_rows`` rows of each."""
    if max_files is not None:
        names = df.select(file_col).distinct().orderBy(file_col).limit(max_files)
        df = df.join(small(names), file_col, "left_semi")
    return df if max_rows is None else take_per_group(df, [file_col], keys, max_rows)


def online_window(
    df: DataFrame, file_col: str, keys: list[str], window_rows: int, max_rows_per_file: int | None = None
) -> DataFrame:
    """ML17: training buffer of at most ``window_rows`` rows over files in order.

    Without a per-file cap every file gets an even share, at least 1000 rows.
    """
    counts = _file_counts(df, file_col)
    if max_rows_per_file is not None:
        share = F.lit(max_rows_per_file)
    else:
        files = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
        counts = counts.withColumn("__files", files)
        share = F.greatest(F.lit(1000), F.floor(F.lit(window_rows) / F.col("__files")))
    quota = _running_quota(counts, file_col, share, window_rows)
    return take_per_group(df, [file_col], keys, quota.select(file_col, "n"))


def balanced_quota(df: DataFrame, file_col: str, keys: list[str], max_rows: int) -> DataFrame:
    """WIN4: an equal share per file, then the global cap in file order."""
    counts = _file_counts(df, file_col).withColumn("__files", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    share = F.greatest(F.lit(1), F.ceil(F.lit(max_rows) / F.col("__files")))
    quota = _running_quota(counts, file_col, share, max_rows)
    return take_per_group(df, [file_col], keys, quota.select(file_col, "n"))


def seeded_sample(
    df: DataFrame, file_col: str, keys: list[str], rows_per_file: int, max_rows: int | None, seed: int = 42
) -> DataFrame:
    """WIN5: k random rows per file, files in order until the cap is reached,
    then a global shuffle cut at the cap."""
    if max_rows is None:
        return take_per_group(df, [file_col], keys, rows_per_file, seed)
    quota = _running_quota(_file_counts(df, file_col), file_col, F.lit(rows_per_file), 2**62)
    started = F.when(F.col("__before") < max_rows, F.col("__c")).otherwise(F.lit(0)).cast("bigint")
    picked = take_per_group(df, [file_col], keys, quota.select(file_col, started.alias("n")), seed)
    return take_per_group(picked, [], keys, max_rows, f"{seed}-global")


def stratified_split(
    df: DataFrame, label: str, keys: list[str], test_fraction: float = 0.2, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """ML5: exact stratified split.

    The test size is ceil(fraction x rows); classes share it in proportion and
    the rows left over go to the largest remainders (then by label).
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    whole = W.partitionBy(F.lit(0))
    per_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c")).withColumn("__n", F.sum("__c").over(whole))
    share = per_label.withColumn("__test", F.ceil(F.col("__n") * F.lit(test_fraction)).cast("bigint"))
    share = share.withColumns(
        {
            "__floor": F.expr("(__c * __test) div __n"),
            "__rest": F.expr("(__c * __test) % __n"),
        }
    )
    extra = F.col("__test") - F.sum("__floor").over(whole)
    order = whole.orderBy(F.desc("__rest"), F.asc(label))
    quota = share.withColumn("n", F.col("__floor") + (F.row_number().over(order) <= extra).cast("int"))
    return mark_per_group(df, [label], keys, quota.select(label, F.col("n").cast("bigint")), seed, out)
