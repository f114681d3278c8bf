"""Rank correlation and precision-recall curves, without a window over the whole table.

What is needed of an order is how many rows stand before a value. Values are counted first, the counts are summed within range partitions,
and the sums of the partitions before are added; rows meet their value's sum by an equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sets import latest_n_per_key
from tidemark.session import reliable_checkpoint


def running_sums(rows: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Rows, one per value of ``order``, with ``before_x`` for each summed column: its sum over all values that come earlier."""
    by = F.desc(order) if descending else F.asc(order)
    ranged = reliable_checkpoint(rows.repartitionByRange(by).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    parts = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(parts), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_pid").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums]).join(totals, "_pid")
    return out.select(*rows.columns, *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"before_{c}") for c in sums])


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the mean of the 1-based places that rows of an equal value share. NULL values have no rank and take none."""
    counts = running_sums(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, ["n"])
    return df.join(counts.select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name)), value, "left")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's coefficient of two columns over the rows that have both, ties averaged; NULL where a column is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    ranked = {}
    for c in (x, y):
        n = running_sums(pairs.groupBy(c).agg(F.sum("_w").alias("n")), c, ["n"])
        # Twice the rank is whole, so the sums below are exact.
        ranked[c] = n.select(c, (2 * F.col("before_n") + F.col("n") + 1).cast("decimal(38,0)").alias(f"_r{c}"))
    j = pairs.join(ranked[x], x).join(ranked[y], y)
    a, b, w = F.col(f"_r{x}"), F.col(f"_r{y}"), F.col("_w").cast("decimal(20,0)")

    def total(e):
        return F.sum(e.cast("decimal(38,0)")).cast("double")
    s = j.agg(total(w).alias("n"), total(w * a).alias("a"), total(w * b).alias("b"), total(w * a * a).alias("aa"), total(w * b * b).alias("bb"), total(w * a * b).alias("ab"))
    n = F.col("n")
    spread = (n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b"))
    return s.select(n.cast("long").alias("n"), F.when(spread > 0, (n * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(spread)).alias("spearman"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score, highest first: rows and positives down to it, precision and recall there."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    levels = known.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    run = running_sums(levels, score, ["n", "hits"], descending=True)
    run = run.select(score, (F.col("before_n") + F.col("n")).alias("taken"), (F.col("before_hits") + F.col("hits")).alias("found"), "before_n", "before_hits")
    total = run.agg(F.max("found").alias("t")).scalar()
    return run.select(score, "taken", "found", (F.col("found") / F.col("taken")).alias("precision"), (F.col("found") / total).alias("recall"),
                      F.when(F.col("before_n") > 0, F.col("before_hits") / F.col("before_n")).otherwise(F.lit(1.0)).alias("precision_before"), (F.col("before_hits") / total).alias("recall_before"))


def precision_recall_area(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by trapezoids between distinct scores (it starts at precision 1), and the average precision by steps."""
    c = precision_recall(df, score, label)
    width = F.col("recall") - F.col("recall_before")
    return c.agg(F.sum(width * (F.col("precision") + F.col("precision_before")) / 2).alias("area"), F.sum(width * F.col("precision")).alias("average_precision"), F.max("taken").alias("n"), F.max("found").alias("positives"))


def precision_at(df: DataFrame, group: list[str], score: str, label: str, tie: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per group the share of positives among its first k rows by score, for each k; fewer rows than k count as they are."""
    top = latest_n_per_key(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), group, [F.desc(score), F.asc(tie)], max(ks))
    return top.groupBy(*group).agg(*[F.avg(F.when(F.col("rank") <= k, F.col(label).cast("double"))).alias(f"precision_{k}") for k in ks])
