"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime-settable options. Wide conditional aggregates (flow records have
# about 80 outputs) lose whole-stage codegen under the default field limit.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.maxFields": "400",
    # A record may repeat a field under two spellings; the later one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Session windows of a stream pre-merge in the input task.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-group top-n filters prune in each input task before the shuffle up
    # to this n; larger n goes through the histogram selection in sampling.py.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the cluster's own setting wins.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="packetloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured
