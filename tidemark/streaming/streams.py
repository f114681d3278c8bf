"""Structured Streaming jobs: the refresh loops of a research archive as incremental queries."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.sets import append_if_absent
from tidemark.sources import store


def read_ticks(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet ticks as a stream. Stored timestamps have no zone, so they are cast before any watermark."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_snapshots(ticks: DataFrame, key="symbol", ts="ts", keep="3 days") -> DataFrame:
    """Each (symbol, instant) once; state older than the retention is dropped with the watermark."""
    return ticks.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key, ts])


def stream_sessions(ticks: DataFrame, key="symbol", ts="ts", price="price", delay="1 day") -> DataFrame:
    """Open, high, low, last and count per symbol and day. Partial aggregates keep a hot symbol to one row per task."""
    day = F.window(ts, "1 day")
    bars = ticks.withWatermark(ts, delay).groupBy(day.alias("w"), key).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("last"), F.count(F.lit(1)).alias("ticks"))
    return bars.select(F.to_date("w.start").alias("session_date"), key, "open", "high", "low", "last", "ticks")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _run(checkpoint: str) -> str:
    """A name for a query, so that folders written by different queries never collide."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def start_append(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """Append rows whose key is new. Each batch of each query (named by its checkpoint) writes a folder of its own, so a
    batch that is run again after a failure replaces its output instead of repeating it, and a later query with a new
    checkpoint adds to what earlier ones stored."""
    run = _run(checkpoint)

    def write(batch: DataFrame, epoch: int):
        own, spark = f"batch-{run}-{epoch}", batch.sparkSession
        stored = batch.limit(0)
        if _exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(f"{path}/*").filter(~F.input_file_name().contains(f"/{own}/"))
        append_if_absent(batch, stored, keys, order).write.mode("overwrite").parquet(f"{path}/{own}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_filings(filings: DataFrame, known: DataFrame, thresholds: DataFrame, forms: list[str]) -> DataFrame:
    """Filings newer than their case's threshold and not known yet, as candidates only: nothing is escalated."""
    live = filings.filter(F.col("form").isin(forms)).join(thresholds, "case_id").filter(F.col("filed_at") > F.col("monitor_since"))
    return live.join(known.select("accession").distinct(), "accession", "left_anti").withColumn("escalated", F.lit(False))


def start_late_evidence(stream: DataFrame, cutoff, on_time: str, late: str, checkpoint: str):
    """Split every batch at the recorded cutoff: late evidence is stored and counted beside the state, never in it.

    A batch writes folders named by query and number: run again it replaces its own rows, and never those of another query."""
    run = _run(checkpoint)

    def write(batch: DataFrame, epoch: int):
        mark = F.coalesce(F.col("available_at") > cutoff, F.lit(True))
        batch.filter(~mark).write.mode("overwrite").parquet(f"{on_time}/batch-{run}-{epoch}")
        batch.filter(mark).write.mode("overwrite").parquet(f"{late}/batch-{run}-{epoch}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], day: str, counts: str, version: str | None = None, order: list[str] | None = None):
    """Bring every batch into a stored table laid out by month and key bucket: with ``version`` the highest of a key stays, else the
    first stored. A batch reads and rewrites the months and buckets that it touches, and run again it changes nothing. What it added
    and refused is written under ``counts``."""
    run = _run(checkpoint)

    def write(batch: DataFrame, epoch: int):
        done = store.merge_rows(batch, path, keys, day, version=version, order=order)
        done.withColumn("epoch", F.lit(epoch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch-{run}-{epoch}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive an append-only stream over everything available into Parquet files and read the table back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Drive a query in update mode, its state bounded by the watermark; of each key the last version counts. Versions of
    different queries on one path are told apart, and among queries the later batch wins by the time it was written."""
    run = _run(checkpoint)

    def write(batch: DataFrame, epoch: int):
        stamp = F.struct(F.lit(time.time_ns()).alias("at"), F.lit(epoch).cast("long").alias("epoch"))
        batch.withColumn("_version", stamp).write.mode("overwrite").parquet(f"{path}/batch-{run}-{epoch}")
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    version = StructField("_version", StructType([StructField("at", LongType()), StructField("epoch", LongType())]))
    stored = stream.sparkSession.read.schema(StructType([*stream.schema.fields, version])).parquet(f"{path}/*")
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_r")).select(*keys, "_r.*")
