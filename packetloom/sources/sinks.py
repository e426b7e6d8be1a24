"""Writers for events, predictions, evaluation tables and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import evaluate
from packetloom.operators.events import timeline


# JSON keeps milliseconds by default; event order needs the microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_events(events: DataFrame, path: str) -> None:
    """SNK1: append events as JSON lines, one folder per day."""
    dated = events.withColumn("event_date", F.to_date("ts"))
    dated.write.mode("append").partitionBy("event_date").option("timestampFormat", TIME_FORMAT).json(path)


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_timeline(events: DataFrame, path: str) -> None:
    """SNK2: append the attack timeline as CSV."""
    timeline(events).write.mode("append").option("header", True).csv(path)


def write_predictions(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK3: features with their scores."""
    scored.write.mode("overwrite").option("header", True).format(fmt).save(path)


def _file_metrics(counts: DataFrame) -> DataFrame:
    ranked = evaluate.file_ranking(evaluate.running_stats(counts)).drop("level")
    scores = evaluate.file_scores(counts).withColumnRenamed("source_file", "__f")
    return ranked.join(scores, F.col("source_file").eqNullSafe(F.col("__f")), "left").drop("__f")


def write_evaluation(counts: DataFrame, path: str, mapping: DataFrame | None = None) -> None:
    """SNK4: per-file metrics and the three confusion layouts."""
    pairs = evaluate.overall_pairs(counts)
    labels = evaluate.label_list(evaluate.label_universe(pairs, mapping))
    dense = evaluate.dense_confusion(pairs, labels)
    shares = evaluate.row_normalised(dense).groupBy("y_true").pivot("y_pred", labels).agg(F.max("share"))
    outputs = {
        "per_file_metrics": _file_metrics(counts),
        "confusion_matrix": evaluate.wide_confusion(pairs, labels),
        "confusion_matrix_normalized": shares,
        "overall_metrics": evaluate.overall_metrics(
            evaluate.per_class(pairs, evaluate.label_universe(pairs, mapping))
        ),
    }
    for name, frame in outputs.items():
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def archive_events(spark: SparkSession, path: str, archive_path: str, before: str, stamp: str, schema) -> None:
    """SNK5: move whole days before a date to the archive ``stamp``.

    The files of those days are listed once, copied to a staging folder,
    counted, and committed by one rename together with the list. Only then the
    listed files are deleted. A rerun after the commit just finishes the
    deletes, one before it copies anew; rows that arrive meanwhile are in other
    files and stay in the log, for a later stamp.
    """
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, staging = f"{archive_path}/archive={stamp}", f"{archive_path}/_staging-{stamp}"
    fs = hadoop_path(archive_path).getFileSystem(conf)
    if not fs.exists(hadoop_path(target)):
        files = _day_files(spark, path, before)
        if not files:
            return
        old = spark.read.schema(schema).option("basePath", path).json(files)
        if "event_date" not in old.columns:
            old = old.withColumn("event_date", F.to_date("ts"))
        old.write.mode("overwrite").partitionBy("event_date").option("timestampFormat", TIME_FORMAT).json(staging)
        copied, source = spark.read.schema(schema).json(staging).count(), old.count()
        if copied != source:
            raise ValueError(f"the archive copy has {copied} of {source} rows")
        listed = spark.createDataFrame([(f,) for f in files], "value string")
        listed.coalesce(1).write.mode("overwrite").text(f"{staging}/{MANIFEST}")
        if not fs.rename(hadoop_path(staging), hadoop_path(target)):
            raise ValueError(f"{target} could not be committed")
    log = hadoop_path(path).getFileSystem(conf)
    for row in spark.read.text(f"{target}/{MANIFEST}").toLocalIterator():
        log.delete(hadoop_path(row["value"]), False)


# Readers skip names that begin with an underscore.
MANIFEST = "_copied"


def _day_files(spark: SparkSession, path: str, before: str) -> list[str]:
    """Data files of the day folders before a date (a listing, as a read plans it)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for folder in fs.listStatus(root):
        name, _, day = folder.getPath().getName().partition("=")
        if name == "event_date" and day < before:
            found += [f.getPath().toString() for f in fs.listStatus(folder.getPath())]
    return sorted(f for f in found if not f.rpartition("/")[2].startswith(("_", ".")))


def write_features(features: DataFrame, mapping: DataFrame, path: str) -> None:
    """SNK6: feature rows and their small label table."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    mapping.coalesce(1).write.mode("overwrite").json(f"{path}/label_mapping")
