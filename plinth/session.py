"""Session helpers: a builder for local runs, and where lineage cuts are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "plinth", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLINTH_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .getOrCreate()
    )


#: Bytes of one Arrow batch sent to a Python worker: bounds its memory however long the texts are.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES, where the session still has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Input of one shuffle partition before Spark merges small ones, and what it merges them to (Spark's default: 64 MB).
PARTITION_INPUT_BYTES = 8 << 20
MERGED_BYTES = 16 << 20


def roomy_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Shuffle partitions in proportion to the input, so that a task's memory does not grow with it.

    Shuffles begin with at least one partition for each PARTITION_INPUT_BYTES and never with fewer than the
    session asks for; adaptive execution merges small ones up to MERGED_BYTES. Narrow rows are many times
    as large in memory as in a shuffle file, so that bound is lower than Spark's. A bound that the session
    has set itself stays.
    """
    conf = spark.conf
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    asked = conf.get("spark.sql.shuffle.partitions")
    current = max(int(conf.get(name, None) or 0), int(asked) if asked.isdigit() else 0)
    if (wanted := -(-input_bytes // PARTITION_INPUT_BYTES)) > current:
        conf.set(name, str(wanted))
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if conf.get(merged, None) in (None, "67108864b", "64MB"):
        conf.set(merged, f"{MERGED_BYTES}b")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's `spark.checkpoint.dir`.

    Only a local master may go without it and gets a temporary folder; a cluster is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a cached block."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared checkpoint folder and read back, for tables that many
    plans read: each reads its columns, with true sizes, instead of building the table anew."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
