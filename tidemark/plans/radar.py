"""Weekly jump candidates and the daily mover screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import volatility_band
from tidemark.operators import events, frames
from tidemark.operators.joins import asof_join, calendar_ordinal, prior_bar
from tidemark.session import reliable_checkpoint

TIERS = {"t3": 0.03, "t5": 0.05, "t7_5": 0.075, "t10": 0.10}


def min_history(hist: DataFrame, minimum: int = policy.RADAR_MIN_SESSIONS, types=policy.INVESTABLE_TYPES) -> DataFrame:
    """Ordinary shares with enough sessions. ``n`` was counted when rows were numbered, so no further grouping is needed."""
    return hist.filter(F.col("security_type").isin(*types) & (F.col("n") >= minimum))


def radar_frame(hist: DataFrame, announcements: DataFrame) -> DataFrame:
    """Everything the radar reads per session, from one window pass over each history."""
    out = frames.results_due_next5(hist, announcements)
    for step in (frames.radar_vol_pop, frames.radar_vol_current, frames.volume_build, frames.forward_move):
        out = step(out)
    return out


def _tiers(move: Column) -> list[Column]:
    return [F.avg((move >= t).cast("double")).alias(name) for name, t in TIERS.items()]


def cohort_rates(frame: DataFrame, minimum: int = policy.MIN_COHORT) -> DataFrame:
    """Jump frequency of every session by (results due, volatility band); at most ten rows."""
    f = frame.filter((F.col("idx") >= policy.SHORT_WINDOW) & F.col("forward_move").isNotNull())
    m = F.col("forward_move")
    return (f.groupBy(F.col("results_due_next5").alias("results_due"), volatility_band("radar_vol_pop").alias("band"))
            .agg(F.count(F.lit(1)).alias("sessions"), F.count_if(m >= policy.JUMP_THRESHOLD).alias("jumps"), *_tiers(m))
            .withColumn("sufficient", F.col("sessions") >= minimum))


def own_rates(frame: DataFrame, lookback: int = policy.RADAR_LOOKBACK) -> DataFrame:
    """Jump frequency of each security over its last measurable year."""
    recent = frame.filter((F.col("idx") >= F.col("n") - lookback - policy.RADAR_HORIZON) & F.col("forward_move").isNotNull())
    m = F.col("forward_move")
    return recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("own_sessions"), F.count_if(m >= policy.JUMP_THRESHOLD).alias("own_jumps"), *[
        c for c in [F.avg((m >= t).cast("double")).alias(f"own_{name}") for name, t in TIERS.items()]])


def weekly_candidates(hist: DataFrame, announcements: DataFrame, today: Column) -> DataFrame:
    """Every security's chance of a sharp move this week: its cohort's rate blended with its own record."""
    frame = radar_frame(min_history(hist), announcements)
    last = frame.filter(F.col("idx") == F.col("n") - 1).withColumn("band", volatility_band("radar_vol_current")).filter("band <> 'unknown'")
    cadence = events.announcement_cadence(announcements, today)
    due = cadence.select("ticker", "expected_date", "precision", F.col("status").alias("calendar_status"), events.results_due_this_week().alias("results_due"))
    rows = last.join(due, "ticker", "left").withColumn("results_due", F.coalesce("results_due", F.lit(False)))
    rows = rows.join(cohort_rates(frame), ["results_due", "band"], "left").join(own_rates(frame), "ticker", "left")
    own = F.coalesce("own_sessions", F.lit(0))
    weight = F.least(F.lit(0.5), own / (own + 250))
    # At full weight a blend of two four-place rates ends in an exact half; the small addend settles it upwards.
    for name in TIERS:
        cohort, mine = F.round(name, 4), F.round(f"own_{name}", 4)
        rows = rows.withColumn(f"chance_{name}", F.when(cohort.isNull(), mine).when(mine.isNull(), cohort)
                               .otherwise(F.round(cohort * (1 - weight) + mine * weight + 1e-9, 4)))
    return (rows.filter("chance_t10 IS NOT NULL")
            .withColumn("volume_build", F.nullif(F.round("volume_build", 3), F.lit(0.0)))
            .select("ticker", F.col("session_date").alias("as_of"), *[f"chance_{t}" for t in TIERS], "band", "results_due", "volume_build",
                    F.col("radar_vol_current").alias("volatility"), "expected_date", "precision", "calendar_status", "sessions", "own_sessions"))


def shortlist(candidates: DataFrame, n: int = policy.DISPLAY) -> DataFrame:
    """The likeliest ``n``: a distributed take-ordered, not a sort of everything."""
    return candidates.orderBy(F.desc("chance_t10"), "ticker").limit(n)


# Fixed value: listing types the mover screen accepts.
MOVER_TYPES = ("CS", "ADRC", "ADRP", "GDR")


def daily_movers(bars: DataFrame, bench: DataFrame, refs: DataFrame, causes: DataFrame, min_price=policy.MIN_PRICE,
                 min_volume=policy.MIN_MEDIAN_DOLLAR_VOLUME, min_sessions=policy.MIN_PRIOR_SESSIONS,
                 per_direction: int = 4, lookback: int = 160) -> DataFrame:
    """Largest benchmark-relative moves of the newest session that pass identity and liquidity screens.

    The window of sessions is found on the calendar first, so only its bars are read. Every move of the newest session meets
    every screen; only those that pass are ranked. A cause is attached only when it is verified and names a source.

    The numbered calendar is small and read in several places: it is computed once and cut off from its lineage, else every
    place repeats it with joins of its own, and the driver holds all their broadcasts at a time.
    """
    pos = reliable_checkpoint(bench.join(calendar_ordinal(bench), "session_date"))
    newest = pos.agg(F.max("ordinal")).scalar()
    level = pos.filter(F.col("ordinal") >= newest - lookback)
    # Measures and prior bars share one partitioning, so all histories cost one shuffle; a row per security leaves it.
    recent = prior_bar(frames.mover_features(bars.join(F.broadcast(level), "session_date")))
    moves = recent.filter((F.col("ordinal") == newest) & (F.col("close") >= min_price) & (F.col("prior_close") > 0)
                          & (F.col("prior_rows") >= min_sessions) & (F.col("median_dollar_volume") >= min_volume))
    before = level.select(F.col("session_date").alias("prior_date"), F.col("bench_close").alias("prior_bench"), F.col("ordinal").alias("prior_ordinal"))
    moves = moves.join(F.broadcast(before), "prior_date")
    moves = (moves.withColumn("move", F.col("close") / F.col("prior_close") - 1)
             .withColumn("benchmark_move", F.col("bench_close") / F.col("prior_bench") - 1)
             .withColumn("relative_move", F.col("move") - F.col("benchmark_move"))
             .withColumn("skipped_sessions", F.col("ordinal") - F.col("prior_ordinal") - 1))
    rows = asof_join(moves.filter(F.col("relative_move") != 0), refs, "ticker", "session_date", "snapshot_date", ["active", "raw_type", "snapshot_date"], tie=["active"])
    rows = rows.filter(F.col("active") & F.col("raw_type").isin(*MOVER_TYPES))
    last_day = pos.agg(F.max("session_date")).scalar()
    good = causes.filter((F.col("session_date") == last_day) & (F.col("status") == "verified") & (F.col("source") != "") & (F.col("url") != ""))
    rows = rows.join(good.select("ticker", "session_date", F.col("cause")), ["ticker", "session_date"], "left")
    rows = rows.withColumn("direction", F.when(F.col("relative_move") > 0, "up").otherwise("down"))
    side = Window.partitionBy("direction").orderBy(F.desc(F.abs("relative_move")), "ticker")
    kept = rows.withColumn("_r", F.row_number().over(side)).filter(F.col("_r") <= per_direction).drop("_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc(F.abs("relative_move")), "ticker")))
