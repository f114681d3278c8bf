"""Unions of closed day intervals, and whether days and ranges lie inside them.

Requests for data come as many overlapping or adjoining stretches. What they cover together is their union, which may have gaps;
the smallest start and the largest end say nothing about those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join


def interval_union(intervals: DataFrame, keys: list[str], start="start", end="end", touch: int = 1) -> DataFrame:
    """Islands of each key: start, end and how many distinct stretches each joins. Stretches at most ``touch`` days apart are one.

    Per key the starts are reduced to one row a day first, so a window never holds more rows than the calendar has days. A stretch
    without a start or an end, or that ends before it starts, covers nothing.
    """
    days = intervals.where(F.col(start) <= F.col(end)).groupBy(*keys, F.to_date(start).alias("_s")).agg(F.max(F.to_date(end)).alias("_e"), F.count_distinct(end).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_s")
    reached = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.datediff("_s", reached) > touch, F.lit(True))
    numbered = days.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.sum("_n").alias("stretches")).drop("_island")


def within_islands(ranges: DataFrame, islands: DataFrame, keys: list[str], first: str, last: str, name: str, start="start", end="end") -> DataFrame:
    """Marks the ranges that lie inside one island of their key. ``islands`` come from ``interval_union``, so only the last one that
    starts by the first day can hold the range."""
    out = asof_join(ranges, islands.withColumnsRenamed({start: "_is", end: "_ie"}), keys, first, "_is", ["_ie"])
    return out.withColumn(name, F.coalesce(F.col("_ie") >= F.col(last), F.lit(False))).drop("_ie", "matched_ts")


def first_proof(intervals: DataFrame, days: DataFrame, keys: list[str], day: str, at: str, payload: list[str], start="start", end="end") -> DataFrame:
    """For every asked day and key the earliest fetched stretch that covers the day, with its columns as a struct ``proof``.

    Stretches of equal bounds count once. What is written out are the days of the stretches that are left, each of which meets the asked
    days by an equality.
    """
    best = intervals.where(F.col(start) <= F.col(end)).groupBy(*keys, F.to_date(start).alias("_s"), F.to_date(end).alias("_e")).agg(F.min(F.struct(at, *payload)).alias("proof"))
    covered = best.select(*keys, F.explode(F.sequence("_s", "_e")).alias(day), "proof")
    return covered.join(days.select(day).distinct(), day, "left_semi").groupBy(day, *keys).agg(F.min("proof").alias("proof"))
