"""Scans of the bar archive and of the derived observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import positive


def _between(df: DataFrame, start, end, ts: str) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("date"))
    return df


def scan_bars(bars: DataFrame, start=None, end=None, ts: str = "session_date") -> DataFrame:
    """Bars of a date range. With files laid out by year the range prunes partitions; order is the reader's choice."""
    return _between(bars, start, end, ts)


def scan_observations(obs: DataFrame, start=None, end=None, version: str | None = None,
                      ts: str = "session_date") -> DataFrame:
    out = _between(obs, start, end, ts)
    return out if version is None else out.filter(F.col("policy_version") == version)


def scan_histories(obs: DataFrame, start=None, end=None, tickers: list[str] | None = None,
                   key: str = "ticker", ts: str = "session_date") -> DataFrame:
    """Clean history per security: rows without a positive close and benchmark are dropped before rows are numbered.

    Adds ``idx`` (0-based position) and ``n`` (length). A security has one row per session, so a window partition is
    bounded by the trading calendar however large the archive grows.
    """
    out = _between(obs, start, end, ts)
    if tickers:
        out = out.filter(F.col(key).isin([t.upper() for t in tickers]))
    out = out.filter(positive("close").isNotNull() & positive("bench_close").isNotNull())
    out = out.withColumn("dollar_volume", positive("dollar_volume"))
    w = Window.partitionBy(key).orderBy(ts)
    return (out.withColumn("idx", F.row_number().over(w) - 1)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))))


def latest_close(bars: DataFrame, key: str = "ticker", ts: str = "session_date") -> DataFrame:
    """Newest positive close per symbol, by partial aggregation only."""
    return (bars.filter(F.col("close") > 0).groupBy(key)
            .agg(F.max_by("close", ts).alias("close"), F.max(ts).alias(ts)))


def missing_sessions(sessions: DataFrame, start: str, end: str, status: str = "status",
                     ts: str = "session_date") -> DataFrame:
    """Weekdays of the range not yet loaded (complete or known to have no data)."""
    days = (sessions.sparkSession.range(1)
            .select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(ts))
            .filter(F.weekday(ts) < 5))
    done = sessions.filter(F.col(status).isin("complete", "no_data")).select(ts).distinct()
    return days.join(done, ts, "left_anti")


def price_points(prices: DataFrame, key: str = "ticker", ts: str = "session_date", arrival: str = "arrival",
                 tolerance: float = 0.05) -> DataFrame:
    """One line per symbol: first and last close, period return and the check of the last close against ``quote``.

    The adjusted close wins over the raw one and, of several rows of a date, the last to arrive. ``quote`` may be NULL.
    """
    price = F.coalesce("adjusted_close", "close")
    daily = (prices.filter(price > 0).groupBy(key, ts)
             .agg(F.max_by(price, arrival).alias("price"), F.max_by("quote", arrival).alias("quote")))
    out = daily.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.min_by("price", ts).alias("first_price"),
        F.max_by("price", ts).alias("last_price"), F.max_by("quote", ts).alias("quote"))
    gap = F.abs(F.col("last_price") / F.col("quote") - 1)
    return (out.withColumn("period_return", F.col("last_price") / F.col("first_price") - 1)
            .withColumn("cross_checked", F.when(F.col("quote") > 0, gap <= tolerance)))
