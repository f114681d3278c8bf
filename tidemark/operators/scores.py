"""Proper scores, calibration, date-clustered bootstrap and drift. Fact rows are aggregated once; everything iterative or
resampled then works on the aggregate."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import clip_probability, logit
from tidemark.operators.sets import global_position
from tidemark.session import reliable_checkpoint


def brier_terms(p="p", y="label") -> dict[str, Column]:
    """Per-row terms whose averages are the Brier score and the log loss."""
    q = clip_probability(p)
    return {"brier": F.pow(F.col(p) - F.col(y), F.lit(2.0)),
            "log_loss": -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))}


def score(df: DataFrame, by: list[str] | None = None, p="p", y="label", reference: Column | None = None) -> DataFrame:
    """Brier, log loss, skill against a constant forecast (the observed rate unless ``reference`` is given), hit rate."""
    t = brier_terms(p, y)
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("_pos"), F.avg(t["brier"]).alias("brier"),
        F.avg(t["log_loss"]).alias("log_loss"), F.avg(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")).alias("hit_rate"))
    rate = F.col("_pos") / F.col("n")
    ref = reference if reference is not None else rate
    base = (F.col("_pos") * F.pow(ref - 1, F.lit(2.0)) + (F.col("n") - F.col("_pos")) * F.pow(ref, F.lit(2.0))) / F.col("n")
    return (out.withColumn("base_rate", rate)
            .withColumn("brier_skill", 1 - F.col("brier") / F.nullif(base, F.lit(0.0))).drop("_pos"))


def reliability(df: DataFrame, bins: int = policy.RELIABILITY_BINS, by: list[str] | None = None, p="p", y="label") -> DataFrame:
    """One row per bin, empty bins included. A bin is found by comparing with its edges, so no product is rounded."""
    at = reduce(lambda a, b: a + b, [(F.col(p) >= k / bins).cast("int") for k in range(1, bins)])
    by = by or []
    got = (df.filter(F.col(p).between(0.0, 1.0)).groupBy(*by, (at + 1).alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).cast("double").alias("sy")))
    groups = got.select(*by).distinct() if by else df.sparkSession.range(1).select()
    empty = groups.select(*by, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), F.lit(0).cast("bigint").alias("n"),
                          F.lit(0.0).alias("sp"), F.lit(0.0).alias("sy"))
    full = got.unionByName(empty).groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"))
    some = F.col("n") > 0
    return full.select(*by, "bin", ((F.col("bin") - 1) / bins).alias("low"), (F.col("bin") / bins).alias("high"), "n",
                       F.when(some, F.col("sp") / F.col("n")).alias("forecast"),
                       F.when(some, F.col("sy") / F.col("n")).alias("observed"))


def ece(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count-weighted gap between the bin means, each taken at four decimals."""
    gap = F.abs(F.round("forecast", 4) - F.round("observed", 4))
    return bins.filter("n > 0").groupBy(*(by or [])).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


SMALL_POINTS = 100_000


def _sums(a: float, b: float, x, y, n) -> tuple[float, ...]:
    q = 1 / (1 + np.exp(-np.clip(a + b * x, -30.0, 30.0)))
    e, w = (q - y) * n, np.maximum(q * (1 - q), 1e-9) * n
    return tuple(float(s) for s in (e.sum(), (e * x).sum(), w.sum(), (w * x).sum(), (w * x * x).sum()))


def _table(rows):
    """The points of a partition as three rows of numbers."""
    yield np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 3).T


def logistic_sums(points: DataFrame, size: int, small: int = SMALL_POINTS):
    """Function (a, b) -> gradient and curvature sums of y ~ a + b * x over (x, y, n) points, and one that frees what it keeps.

    Up to ``small`` distinct points (checked by the caller's count) the three columns are fetched once and summed with
    numpy; beyond that they are cached on the executors as tables of numbers, of ``SMALL_POINTS`` a task. A call then is one small job
    without a plan of its own, since a fit makes hundreds of them, and only five sums per task reach the driver.
    """
    if size <= small:
        data = points.select("x", "y", "n").toPandas()
        x, y, n = (data[c].to_numpy(dtype=float) for c in ("x", "y", "n"))
        return lambda a, b: _sums(a, b, x, y, n), lambda: None
    known = points.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y", "n")
    tables = known.repartition(1 + size // SMALL_POINTS).rdd.mapPartitions(_table).persist()

    def distributed(a: float, b: float) -> tuple[float, ...]:
        parts = tables.map(lambda t: _sums(a, b, *t)).collect()
        return tuple(math.fsum(p[i] for p in parts) for i in range(5))
    return distributed, tables.unpersist


def calibration_slope(df: DataFrame, p="p", y="label", max_steps: int = 200, small: int = SMALL_POINTS) -> DataFrame:
    """Logistic recalibration y ~ a + b * logit(p) by Newton steps over merged (p, label) points."""
    spark = df.sparkSession
    points = (df.groupBy(F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
              .agg(F.count(F.lit(1)).alias("n")).select(logit("p").alias("x"), "y", "n")).persist()
    size = points.agg(F.sum("n").alias("n"), F.count_distinct("y").alias("k"), F.count(F.lit(1)).alias("m")).first()
    schema = "slope double, intercept double, samples long"
    if not size["n"] or size["n"] < 10 or size["k"] < 2:
        points.unpersist()
        return spark.createDataFrame([(None, None, size["n"] or 0)], schema)
    sums, free = logistic_sums(points, size["m"], small)
    a, b = 0.0, 1.0
    for _ in range(max_steps):
        ga, gb, aa, ab, bb = sums(a, b)
        det = aa * bb - ab ** 2
        if abs(det) < 1e-12:
            break
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        a, b = a - da, b - db
        if abs(da) < 1e-8 and abs(db) < 1e-8:
            break
    free(), points.unpersist()
    return spark.createDataFrame([(b, a, size["n"])], schema)


def draw_digest(seed: int, replicate: Column, slot: Column) -> Column:
    """Reproducible draw before the modulus: the first 32 bits of an MD5 of (seed, replicate, slot)."""
    text = F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def cluster_bootstrap(df: DataFrame, cluster: str, num: Column, den: Column, samples: int = policy.BOOTSTRAP_SAMPLES,
                      seed: int = 20260804, by: list[str] | None = None) -> DataFrame:
    """95% interval of sum(num)/sum(den), resampling whole clusters.

    Rows collapse to one pair of sums per cluster before anything is drawn; a replicate then touches clusters (dates),
    never facts. Percentiles are order statistics at int(q * (n - 1)) of the ``samples`` estimates, without interpolation.
    """
    by = by or []
    sums = df.groupBy(*by, cluster).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    if by:
        group = Window.partitionBy(*by)
        sums = sums.withColumn("_slot", F.row_number().over(group.orderBy(cluster)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    else:
        placed = global_position(sums, [cluster], "_slot")
        sums = placed.withColumn("_n", F.lit(placed.count()))
    sums = reliable_checkpoint(sums)
    # The digest of (replicate, slot) does not depend on the group, so it is taken once per slot for all groups. The sums are few bytes but
    # each row becomes ``samples`` draws, so both sides are dealt over all cores explicitly, by the slot that joins them. No list is empty;
    # the outer explosion keeps the planner from testing that, for which it would take all digests once more before they are dealt out.
    wide = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    digests = (sums.select("_slot").repartition(wide, "_slot").distinct()
               .withColumn("_h", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda r: draw_digest(seed, r, F.col("_slot")))))
    draws = (sums.filter("_n >= 3").select(*by, "_slot", "_n").repartition(wide, "_slot").join(digests, "_slot").select(*by, "_n", F.posexplode_outer("_h").alias("_rep", "_x"))
             .select(*by, "_rep", F.pmod("_x", "_n").alias("_slot")))
    est = (draws.join(sums.select(*by, "_slot", "_num", "_den"), [*by, "_slot"])
           .groupBy(*by, "_rep").agg((F.sum("_num") / F.nullif(F.sum("_den"), F.lit(0.0))).alias("_e")))
    ordered = est.filter(F.col("_e").isNotNull() & ~F.isnan("_e")).groupBy(*by).agg(F.sort_array(F.collect_list("_e")).alias("_a"))
    m = F.size("_a")

    def pick(q):
        return F.when(m >= 20, F.get("_a", F.floor(F.lit(q) * (m - 1)).cast("int")))
    ends = ordered.select(*by, pick(0.025).alias("lower95"), pick(0.975).alias("upper95"), m.alias("samples"))
    clusters = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"))
    if by:
        return clusters.join(ends, by, "left").fillna(0, ["samples"])
    return clusters.withColumn("_j", F.lit(1)).join(ends.withColumn("_j", F.lit(1)), "_j", "left").drop("_j").fillna(0, ["samples"])


def scorecard(df: DataFrame, cluster="session_date", p="p", y="label") -> DataFrame:
    """Every score of one forecast set in one row, with the interval of its skill."""
    one = F.lit(1).alias("_j")
    head = score(df, p=p, y=y)
    gap = ece(reliability(df, p=p, y=y))
    rate = head.select("base_rate").scalar()
    t = brier_terms(p, y)["brier"]
    ref = F.pow(F.col("_rate") - F.col(y), F.lit(2.0))
    ci = cluster_bootstrap(df.withColumn("_rate", rate), cluster, ref - t, ref)
    cal = calibration_slope(df, p, y)
    out = head.select("*", one)
    for part in (gap, ci.select("lower95", "upper95", "clusters"), cal.select("slope", "intercept")):
        out = out.join(part.select("*", one), "_j")
    return out.drop("_j")


def _recent_boundary(df: DataFrame, sessions: int, ts: str) -> Column:
    """First of the newest ``sessions`` dates, as a scalar subquery (NULL when there are not more dates than that)."""
    dates = df.select(F.col(ts).alias("_d")).distinct().orderBy(F.desc("_d")).limit(sessions + 1)
    return dates.agg(F.when(F.count(F.lit(1)) > sessions, F.get(F.sort_array(F.collect_list("_d")), F.lit(1)))).scalar()


def severity(shift: Column, warn: float = 0.5, serious: float = 1.0) -> Column:
    return (F.when(shift.isNull(), "unknown").when(F.abs(shift) >= serious, "serious")
            .when(F.abs(shift) >= warn, "watch").otherwise("stable"))


def feature_drift(df: DataFrame, cols: list[str], sessions: int = 21, ts="session_date") -> DataFrame:
    """Shift of each feature's mean in the newest sessions, in baseline deviations. The rows are read once: count, mean and squares about
    the mean of every session, from which the boundary, the means and the deviations follow."""
    per = df.groupBy(ts).agg(*[f(c).alias(f"{c}__{k}") for c in cols for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{k}").alias(f"_{k}") for k in "nmv"]) for c in cols]))
    per = reliable_checkpoint(per.select(ts, cells.alias("_c")).select(ts, "_c.*"))
    tagged = per.withColumn("_new", F.col(ts) >= _recent_boundary(per, sessions, ts)).filter(F.col("_new").isNotNull())
    old = ~F.col("_new")

    def mean(rows):
        return F.sum(F.when(rows, F.col("_n") * F.col("_m"))) / F.nullif(F.sum(F.when(rows, F.col("_n"))), F.lit(0))
    means = tagged.groupBy("feature").agg(mean(old).alias("baseline_mean"), mean(F.col("_new")).alias("recent_mean"))
    about = F.col("_n") * (F.col("_v") + F.pow(F.col("_m") - F.col("baseline_mean"), F.lit(2.0)))
    held = tagged.filter(old).join(means, "feature").groupBy("feature").agg(F.sum("_n").alias("_k"), F.sum(about).alias("_s"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    out = names.join(means, "feature", "left").join(held, "feature", "left").select("feature", "baseline_mean", "recent_mean", F.when(F.col("_k") > 1, F.sqrt(F.col("_s") / (F.col("_k") - 1))).alias("_sd"))
    constant = F.col("_sd") <= F.greatest(F.abs("baseline_mean"), F.lit(1.0)) * 1e-9
    shift = F.when(~constant, (F.col("recent_mean") - F.col("baseline_mean")) / F.col("_sd"))
    return (out.withColumn("shift", shift)
            .withColumn("severity", F.when(constant, "constant").otherwise(severity(F.col("shift")))).drop("_sd"))


def promotion_gates(metrics: DataFrame) -> DataFrame:
    """Failed gates of a one-row metrics table; a missing metric fails its gate."""
    g = policy.PROMOTION

    def below(c, limit):
        return F.coalesce(F.col(c) < limit, F.lit(True))
    double_base = F.coalesce(F.col("alert_precision") < 2 * F.col("base_rate"), F.lit(True))
    pairs = [(below("sessions", g["sessions"]), "sessions"), (below("matured", g["matured"]), "matured"),
             (below("watches", g["watches"]), "watches"), (below("swings", g["swings"]), "swings"),
             (below("brier_skill", g["brier_skill"]), "brier skill"),
             (F.coalesce(F.col("calibration_error") > g["calibration_error"], F.lit(True)), "calibration"),
             (double_base, "precision"),
             (F.coalesce(F.col("precision_lower95") <= F.col("base_rate"), F.lit(True)), "precision interval"),
             (below("directional_accuracy", g["directional_accuracy"]), "direction"),
             (~F.coalesce(~F.col("critical_incident"), F.lit(False)), "incident review"),
             (~F.coalesce(F.col("risk_review_accepted"), F.lit(False)), "risk review")]
    return metrics.withColumn("gate_failures", F.array_compact(F.array(*[F.when(b, F.lit(t)) for b, t in pairs])))
