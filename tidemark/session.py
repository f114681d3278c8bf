"""Session defaults and the helpers every job needs: reliable checkpoints, shared scratch folders, spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tidemark", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on. On a cluster leave ``master`` and partitions to spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = (builder.config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        # A local master runs everything in the driver's JVM, whose default heap is far too small for that.
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder, so a lost executor never loses the result.

    The folder named by ``spark.checkpoint.dir`` is used; only a local session without one (a test) gets its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))
    return df.checkpoint(eager=eager)


def _local_folder(spark: SparkSession) -> str:
    """A folder of this machine, for a session that runs on this machine alone."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate files: under the cluster's shared checkpoint folder, or under /tmp in a local test."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}" if shared else _local_folder(spark)


#: Bytes of stored input for which a shuffle starts with one partition.
SHUFFLE_BYTES = 8 << 20


def widen(spark: SparkSession, folder: str) -> None:
    """Let shuffles start as wide as the stored input asks for, so that a task's share does not grow with the input; adaptive
    execution joins partitions that turn out small. Never narrower than the session's own width."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    wanted = -(-(files.agg(F.sum("length")).first()[0] or 0) // SHUFFLE_BYTES)  # only the listing is read, no content
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    else:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out before per-row work that is heavy on the processor, to the session's shuffle width unless told."""
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
