"""Stored tables: rows laid out by month and key bucket, and histories laid out by year and bucketed by ticker.

A table of keyed rows is a folder ``month=YYYY-MM/bucket=N``. Bringing rows in reads and rewrites only the months and buckets that they touch,
by dynamic partition overwrite; all other files stay as they are. The set of touched partitions is known to the driver: it is bounded by
the months of the table times ``BUCKETS``, whatever the rows. Writers are single; a batch that is brought in again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.operators.sets import append_counts, append_if_absent, upsert_latest
from tidemark.session import reliable_checkpoint

BUCKETS = 32


def _placed(rows: DataFrame, keys: list[str], day: str, buckets: int) -> DataFrame:
    return rows.withColumn("month", F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with its two layout columns."""
    return spark.read.schema(StructType([*schema.fields, StructField("month", StringType()), StructField("bucket", IntegerType())])).parquet(path)


def touched_rows(stored: DataFrame, touched: list[tuple[str, int]]) -> DataFrame:
    """The stored rows of some partitions. The filter names partition columns only, so no other file is opened."""
    by_month: dict[str, list[int]] = {}
    for month, bucket in touched:
        by_month.setdefault(month, []).append(bucket)
    groups: dict[tuple[int, ...], list[str]] = {}  # months that touch the same buckets share a condition
    for month, found in by_month.items():
        groups.setdefault(tuple(sorted(found)), []).append(month)
    where: Column = F.lit(False)
    for found, months in groups.items():
        where = where | (F.col("month").isin(*months) & F.col("bucket").isin(*found))
    return stored.where(where)


def merge_rows(new: DataFrame, path: str, keys: list[str], day: str, version: str | None = None, order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Bring ``new`` into the table; returns how many keys were added and how many rows refused or replaced.

    With ``version`` the highest version of a key stays, else a stored key is kept and of new rows with one key the first by ``order`` is
    taken. A key must keep its day: the table is laid out by it.
    """
    spark, schema = new.sparkSession, new.schema
    placed = reliable_checkpoint(_placed(new, keys, day, buckets))
    touched = [(r.month, r.bucket) for r in placed.select("month", "bucket").distinct().collect()]
    if not touched:
        return spark.createDataFrame([(0, 0)], "appended long, refused long")
    before = touched_rows(read_store(spark, path, schema), touched) if _exists(spark, path) else placed.limit(0)
    counts = reliable_checkpoint(append_counts(placed, before, keys))
    layout = [*keys, "month", "bucket"]
    if version:
        merged = upsert_latest(placed, before, layout, version)
    else:
        merged = before.unionByName(append_if_absent(placed, before, keys, order or [c for c in new.columns if c not in keys]))
    merged = merged.select(*new.columns, "month", "bucket").repartition("month", "bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "bucket").parquet(path)
    return counts


# --- histories -------------------------------------------------------------------------------------------------------

def write_history(rows: DataFrame, name: str, path: str | None = None, key="ticker", ts="session_date", buckets: int = 64) -> str:
    """Store a history as a table partitioned by year and bucketed and sorted by key, once; returns the table's name.

    Range scans then read the years they name, and windows, groupings and joins by key between tables of equal bucket counts need no exchange
    (a join on key and day as well only with ``spark.sql.requireAllClusterKeysForCoPartition`` off).
    """
    years = rows.withColumn("year", F.year(ts))
    # One task per year and bucket writes one file each, however the rows lay before.
    writer = years.repartition(buckets, key).sortWithinPartitions("year", key, ts).write.partitionBy("year").bucketBy(buckets, key).sortBy(key, ts).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def scan_history(spark: SparkSession, name: str, start=None, end=None, ts="session_date") -> DataFrame:
    """Rows of a stored history between two days, both included; the years are pruned before any file is opened."""
    rows = spark.table(name)
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            rows = rows.where(keep(F.col("year"), int(str(bound)[:4])) & keep(F.col(ts), F.lit(str(bound)).cast("date")))
    return rows.drop("year")


def scratch_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
