"""STR5, STR9: streams scored by the newest stored ensemble.

Every training run stores its ensemble in a folder of its own and then adds
one row to the version table. That row is the commit: a run that dies before
it leaves a folder nobody reads. A micro-batch notes the version it takes
before it scores, so a replay of the batch scores with the same ensemble,
whatever has been published since.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators import events as log
from packetloom.operators.models import Ensemble
from packetloom.sources.sinks import TIME_FORMAT
from packetloom.streaming.streams import _start

# Versions count up; two runs that take the same number are told apart by time, then by folder.
VERSION_SCHEMA = "version bigint, published_us bigint, folder string"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(VERSION_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _append(spark: SparkSession, row: tuple, path: str, mode: str) -> None:
    spark.createDataFrame([row], VERSION_SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def newest_version(spark: SparkSession, root: str) -> tuple[int, int, str] | None:
    """(number, publication time in us, folder) of the newest committed version, None before the first."""
    versions = _read(spark, f"{root}/versions")
    if versions is None:
        return None
    return _newest_row(versions)


def _newest_row(versions: DataFrame) -> tuple[int, int, str] | None:
    found = versions.agg(F.max(F.struct("version", "published_us", "folder")).alias("v")).first()["v"]
    return None if found is None else tuple(found)


def publish(ensemble: Ensemble, root: str) -> int:
    """Store ``ensemble`` as the next version under ``root`` and return its number."""
    spark = ensemble.mapping.sparkSession
    last = newest_version(spark, root)
    version = 1 if last is None else last[0] + 1
    folder = f"ensembles/{version}-{uuid.uuid4().hex}"
    ensemble.save(f"{root}/{folder}")
    _append(spark, (version, time.time_ns() // 1000, folder), f"{root}/versions", "append")
    return version


def batch_version(spark: SparkSession, root: str, notes: str, batch_id: int) -> tuple[int, int, str]:
    """The version that a micro-batch is bound to; the first call binds the newest one."""
    note = f"{notes}/batch={batch_id}"
    noted = _read(spark, note)
    bound = None if noted is None else _newest_row(noted)
    if bound is not None:
        return bound
    bound = newest_version(spark, root)
    if bound is None:
        raise ValueError(f"no ensemble is published under {root}")
    _append(spark, bound, note, "overwrite")
    return bound


def version_scorer(root: str, notes: str) -> Callable[[DataFrame, int], DataFrame]:
    """Function of (batch, batch id) that scores with the batch's version, named in ``model_version``.

    The ensemble in use stays loaded until a batch takes another version.
    """
    held: dict[str, Ensemble] = {}

    def score(batch: DataFrame, batch_id: int) -> DataFrame:
        version, _, folder = batch_version(batch.sparkSession, root, notes, batch_id)
        if folder not in held:
            held.clear()
            held[folder] = Ensemble.load(batch.sparkSession, f"{root}/{folder}")
        return held[folder].score(batch).withColumn("model_version", F.lit(version).cast("bigint"))

    return score


def start_versioned_scoring(
    records: DataFrame, root: str, out: str, checkpoint: str, uid_keys: list[str], available_now: bool = False
) -> StreamingQuery:
    """STR5: score each micro-batch with the newest ensemble under ``root`` and log its events.

    A batch owns the folder ``batch=<id>`` of ``out`` and a note of its version
    beside the checkpoint, so a replay writes the same rows to the same place.
    """
    score = version_scorer(root, f"{checkpoint}-versions")

    def write(batch: DataFrame, batch_id: int) -> None:
        events = log.to_events(score(batch, batch_id), uid_keys)
        events.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(f"{out}/batch={batch_id}")

    return _start(records.writeStream.foreachBatch(write), checkpoint, available_now)
