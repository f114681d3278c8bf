"""Named ratings, estimate revisions and surprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clamp, finite, rating_direction, symbol
from tidemark.operators.sets import latest_n_per_key


def analyst_actions(rows: DataFrame) -> DataFrame:
    """Usable rating rows: a symbol, a date and a firm are required; targets parse to numbers or stay unknown."""
    out = (rows.withColumn("symbol", symbol("ticker")).withColumn("firm", F.nullif(F.trim("firm"), F.lit("")))
           .withColumn("analyst", F.nullif(F.trim("analyst"), F.lit(""))))
    return (out.filter("symbol IS NOT NULL AND date IS NOT NULL AND firm IS NOT NULL").withColumn("direction", rating_direction("rating"))
            .withColumn("price_target", finite("target")).withColumn("prior_target", finite("target_prior")))


def analyst_summary(actions: DataFrame, consensus: DataFrame, today: Column, recent_days: int = 90, key="symbol") -> DataFrame:
    """Recent ratings per symbol, their share of positive ones and a check against the broad consensus.

    Rows collapse per (symbol, firm, analyst) first; distinct firms and analysts are then counted on that small table.
    """
    live = actions.filter(F.datediff(today, "date") <= recent_days)
    directional = F.col("direction") != "unknown"
    points = F.when(F.col("direction") == "positive", 80).when(F.col("direction") == "neutral", 50).when(F.col("direction") == "negative", 20)
    per = live.groupBy(key, "firm", "analyst").agg(F.count(F.lit(1)).alias("n"), F.count_if(directional).alias("d"),
                                                   F.count_if(F.col("direction") == "positive").alias("p"), F.sum(points).alias("s"))
    out = per.groupBy(key).agg(F.sum("n").alias("actions"), F.count_distinct("firm").alias("firms"), F.count_distinct("analyst").alias("analysts"),
                               F.sum("d").alias("_d"), F.sum("p").alias("_p"), F.sum("s").alias("_s"))
    out = (out.withColumn("positive_share", F.col("_p") / F.nullif(F.col("_d"), F.lit(0)) * 100).withColumn("score", F.col("_s") / F.nullif(F.col("_d"), F.lit(0)))
           .join(consensus, key, "left").withColumn("difference", F.abs(F.col("positive_share") - F.col("consensus_share"))))
    conflict = F.coalesce(F.col("difference") > 30, F.lit(False))
    ready = (F.col("firms") >= 3) & (F.col("_d") > 0) & F.col("difference").isNotNull() & ~conflict
    check = F.when(conflict, "review").when(F.col("difference").isNotNull(), "agrees").otherwise("unavailable")
    return out.withColumn("cross_check", check).withColumn("ready", ready).drop("_d", "_p", "_s")


def estimate_revision(snapshots: DataFrame, key="symbol", fiscal="fiscal_date", captured="captured") -> DataFrame:
    """Change of each capture against the previous capture of the same fiscal date; the direction needs 1% on average."""
    w = Window.partitionBy(key, fiscal).orderBy(captured)

    def change(c):
        prior = F.lag(c).over(w)
        return (F.col(c) - prior) / F.abs(F.nullif(prior, F.lit(0.0))) * 100
    out = (snapshots.withColumn("prior_captured", F.lag(captured).over(w)).withColumn("eps_change", change("eps")).withColumn("revenue_change", change("revenue")))
    parts = F.array_compact(F.array("eps_change", "revenue_change"))
    mean = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(parts), F.lit(0))
    return (out.withColumn("status", F.when(F.col("prior_captured").isNull(), "baseline").otherwise("compared"))
            .withColumn("direction", F.when(F.col("prior_captured").isNull(), F.lit(None)).when(mean >= 1, "up").when(mean <= -1, "down").otherwise("unchanged")))


def nearest_estimate(estimates: DataFrame, today: Column, key="symbol", fiscal="fiscal_date", slack: int = 45) -> DataFrame:
    """Estimate of the first fiscal date that is not more than ``slack`` days past."""
    rest = [c for c in estimates.columns if c not in (key, fiscal)]
    live = estimates.filter(F.col(fiscal) >= F.date_sub(today, slack))
    return live.groupBy(key).agg(F.min(F.struct(fiscal, *rest)).alias("e")).select(key, "e.*")


def earnings_surprise(reports: DataFrame, key="symbol", order="reported_on", tie="report_id", n: int = 4) -> DataFrame:
    """Mean of the last four surprises in percent, each clamped to +-30, and how many beat."""
    s = (F.col("actual") - F.col("expected")) / F.abs(F.nullif(F.col("expected"), F.lit(0.0))) * 100
    last = latest_n_per_key(reports.withColumn("surprise", clamp(s, -30.0, 30.0)).filter("surprise IS NOT NULL"), [key], [F.desc(order), F.desc(tie)], n)
    return last.groupBy(key).agg(F.count(F.lit(1)).alias("reports"), F.avg("surprise").alias("mean_surprise"), F.count_if(F.col("surprise") > 0).alias("beats"))
