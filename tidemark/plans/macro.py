"""Macro regime at any number of cutoffs, from observations and release vintages that existed by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import months_before, qoq_annualised
from tidemark.operators.joins import asof_join

# Series and the ages in days after which a vintage or an observation is stale.
SERIES = {"DGS2": (7, 10), "DGS10": (7, 10), "CPIAUCSL": (45, 75), "UNRATE": (45, 75), "GDPC1": (120, 240)}


def macro_lags(observations: DataFrame, lags=(3, 12, 15)) -> DataFrame:
    """Each observation with the value of the same series exactly ``n`` calendar months earlier, by equi-joins."""
    out = observations
    for n in lags:
        past = observations.select("series", F.col("date").alias(f"_d{n}"), F.col("value").alias(f"lag_{n}"))
        out = out.withColumn(f"_d{n}", months_before("date", n)).join(past, ["series", f"_d{n}"], "left").drop(f"_d{n}")
    return out


def macro_regime(observations: DataFrame, vintages: DataFrame, cutoffs: DataFrame, series: dict = SERIES) -> DataFrame:
    """One row per cutoff: signals, derived rates, missing and stale series, and a label only when everything is present."""
    cells = F.array(*[F.struct(F.lit(s).alias("series"), F.lit(v).alias("max_vintage"), F.lit(o).alias("max_obs")) for s, (v, o) in series.items()])
    asks = cutoffs.select("cutoff", F.explode(cells).alias("c")).select("cutoff", "c.*")
    usable = observations.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    obs = asof_join(asks, macro_lags(usable), "series", "cutoff", "date", ["date", "value", "lag_3", "lag_12", "lag_15"]).drop("matched_ts")
    both = asof_join(obs, vintages, "series", "cutoff", "vintage", ["vintage"]).drop("matched_ts")
    stale = (F.coalesce(F.datediff("cutoff", "vintage") > F.col("max_vintage"), F.lit(True)) | F.coalesce(F.datediff("cutoff", "date") > F.col("max_obs"), F.lit(True)))
    both = both.withColumn("_missing", F.col("date").isNull() | F.col("vintage").isNull()).withColumn("_stale", stale)

    def at(s, c):
        return F.max(F.when(F.col("series") == s, F.col(c)))
    w = both.groupBy("cutoff").agg(
        *[at(s, c).alias(f"{s}_{c}") for s, c in (("CPIAUCSL", "value"), ("CPIAUCSL", "lag_12"), ("CPIAUCSL", "lag_3"), ("CPIAUCSL", "lag_15"), ("UNRATE", "value"),
                                                  ("UNRATE", "lag_3"), ("GDPC1", "value"), ("GDPC1", "lag_3"), ("DGS2", "value"), ("DGS10", "value"), ("DGS2", "date"), ("DGS10", "date"))],
        F.count_if("_missing").alias("missing_series"), F.count_if("_stale").alias("stale_series"))

    def pct(a, b):
        return F.when(F.col(b) > 0, (F.col(a) / F.col(b) - 1) * 100)
    w = (w.withColumn("inflation", pct("CPIAUCSL_value", "CPIAUCSL_lag_12"))
         .withColumn("inflation_direction", F.col("inflation") - pct("CPIAUCSL_lag_3", "CPIAUCSL_lag_15"))
         .withColumn("unemployment_change", F.col("UNRATE_value") - F.col("UNRATE_lag_3"))
         .withColumn("growth", F.when(F.col("GDPC1_lag_3") > 0, qoq_annualised("GDPC1_value", "GDPC1_lag_3") * 100))
         .withColumn("curve", F.when(F.col("DGS2_date") == F.col("DGS10_date"), F.col("DGS10_value") - F.col("DGS2_value"))))
    derived = ["inflation", "inflation_direction", "unemployment_change", "growth", "curve"]
    gaps = sum((F.col(c).isNull().cast("int") for c in derived), F.lit(0))
    w = w.withColumn("ready", (F.col("missing_series") == 0) & (F.col("stale_series") == 0) & (gaps == 0))
    g, i, u, c = F.col("growth"), F.col("inflation"), F.col("unemployment_change"), F.col("curve")
    w = (w.withColumn("growth_signal", F.when(g < 0, "contracting").when(g > 0, "expanding").otherwise("unclear"))
         .withColumn("inflation_signal", F.when(i >= 3, "elevated").when(i < 1, "low").when(i.isNotNull(), "moderate").otherwise("unclear"))
         .withColumn("labor_signal", F.when(u >= 0.3, "weakening").when(u <= -0.3, "improving").when(u.isNotNull(), "stable").otherwise("unclear"))
         .withColumn("rates_signal", F.when(c < 0, "inverted").when(c.isNotNull(), "upward_sloping").otherwise("unclear")))
    label = (F.when(~F.col("ready"), "unavailable").when((F.col("growth_signal") == "contracting") & (F.col("labor_signal") == "weakening"), "downturn_risk")
             .when((F.col("growth_signal") == "expanding") & (F.col("inflation_signal") == "elevated"), "inflationary_expansion")
             .when(F.col("growth_signal") == "expanding", "expansion").otherwise("mixed"))
    status = (F.when(F.col("ready"), "ready").when(F.col("missing_series") > 0, "unavailable").when(F.col("stale_series") > 0, "stale").otherwise("partial"))
    return w.withColumn("label", label).withColumn("status", status).select("cutoff", *derived, "growth_signal", "inflation_signal", "labor_signal", "rates_signal",
                                                                             "missing_series", "stale_series", "ready", "label", "status")
