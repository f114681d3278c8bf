"""Exact grouped medians that never gather a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median", accuracy: int = 20_000) -> DataFrame:
    """Exact median per group in two passes of partial aggregation.

    A sketch brackets the middle of each group; counts below the bracket give the rank the bracket starts at; only the
    distinct values inside it (about 0.04% of the group) are then ordered. Whether the middle lies inside is checked; a
    group whose bracket misses it is ordered as a whole in a job of its own, which is planned only if there is one. So the sketch decides
    cost, never the answer. The values are checkpointed, so what they come from is computed once.
    """
    eps = 4.0 / accuracy
    v = F.col(value)
    rows = reliable_checkpoint(df.filter(v.isNotNull()).select(*by, value))
    mid = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(v, F.array(F.lit(0.5 - eps), F.lit(0.5 + eps)), F.lit(accuracy)).alias("_q"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    mid = reliable_checkpoint(mid.withColumn("_lo", F.get("_q", F.lit(0))).withColumn("_hi", F.get("_q", F.lit(1))).drop("_q"))
    found = reliable_checkpoint(_middle(rows, mid, by, value))
    missed = found.filter("NOT _sure").select(*by)
    if not missed.limit(1).count():
        return found.select(*by, F.col("_median").alias(name))
    whole = _middle(rows.join(missed, by, "left_semi"), mid.withColumn("_lo", F.col("_min")).withColumn("_hi", F.col("_max")), by, value)
    return found.filter("_sure").unionByName(whole).select(*by, F.col("_median").alias(name))


def _middle(rows: DataFrame, mid: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of the values between _lo and _hi by their ranks, and whether both middle ranks lie there."""
    v = F.col(value)
    j = rows.select(*by, value).join(mid, by)
    below = j.groupBy(*by).agg(F.count_if(v < F.col("_lo")).alias("_below"), F.first("_n").alias("_n"))
    inside = (j.filter(v.between(F.col("_lo"), F.col("_hi"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
              .join(below, by))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("_upto", F.col("_below") + F.sum("_k").over(run))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    low, high = F.min(F.when(F.col("_upto") >= first, v)), F.min(F.when(F.col("_upto") >= second, v))
    sure = F.coalesce((F.first("_below") < F.first(first)) & (F.max("_upto") >= F.first(second)), F.lit(False))
    return upto.groupBy(*by).agg(((low + high) / 2).alias("_median"), sure.alias("_sure"))
