"""Trailing and forward window columns over per-security histories.

Every function adds one column named after itself and uses the same partitioning and ordering, so Spark plans one
exchange and one sort for any number of them. Apply to ``scan_histories`` output: frames count rows, not days.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark import policy
from tidemark.functions import ratio

ANNUAL = math.sqrt(policy.SESSIONS_PER_YEAR)


def _w(key="ticker", ts="session_date"):
    return Window.partitionBy(key).orderBy(ts)


def _rows(start: int, end: int, key="ticker", ts="session_date"):
    return _w(key, ts).rowsBetween(start, end)


def _change(col: str, n: int, key: str, ts: str) -> Column:
    return F.col(col) / F.lag(col, n).over(_w(key, ts)) - 1


def daily_return(df: DataFrame, key="ticker", ts="session_date", price="close", name="daily_return") -> DataFrame:
    return df.withColumn(name, _change(price, 1, key, ts))


def excess_return(df: DataFrame, n: int, key="ticker", ts="session_date", name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"excess_return_{n}d",
                         _change("close", n, key, ts) - _change("bench_close", n, key, ts))


def _returns(df: DataFrame, key, ts) -> DataFrame:
    """Both return series, computed once per plan."""
    if "_r" in df.columns:
        return df
    return df.withColumn("_r", _change("close", 1, key, ts)).withColumn("_rb", _change("bench_close", 1, key, ts))


def volatility_21d(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Sample deviation of the last 21 simple returns, annualised; NULL below two returns."""
    sd = F.stddev_samp("_r").over(_rows(-20, 0, key, ts))
    return _returns(df, key, ts).withColumn("volatility_21d", sd * ANNUAL)


def volatility_ratio(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    f = _rows(-20, 0, key, ts)
    return _returns(df, key, ts).withColumn(
        "volatility_ratio", ratio(F.stddev_samp("_r").over(f), F.stddev_samp("_rb").over(f)))


def drawdown_252(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    return df.withColumn("drawdown_252", F.col("close") / F.max("close").over(_rows(-252, 0, key, ts)) - 1)


def distance_63(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    return df.withColumn("distance_63", F.col("close") / F.avg("close").over(_rows(-63, 0, key, ts)) - 1)


def rolling_medians(df: DataFrame, col: str, frames: dict[str, tuple[int, int]], key="ticker", ts="session_date") -> DataFrame:
    """Exact medians of the values inside frames of a fixed number of rows, by name. A frame's values are gathered and sorted as
    plain numbers once per row, which costs a fraction of an exact percentile's counting by value."""
    out = df.withColumns({f"_l_{n}": F.collect_list(F.col(col).cast("double")).over(_rows(a, b, key, ts)) for n, (a, b) in frames.items()})
    out = out.withColumns({f"_l_{n}": F.sort_array(f"_l_{n}") for n in frames})

    def middle(n):
        values = F.col(f"_l_{n}")
        return F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")) * 0.5 + F.get(values, F.floor(F.size(values) / 2).cast("int")) * 0.5
    return out.withColumns({n: middle(n) for n in frames}).drop(*[f"_l_{n}" for n in frames])


def liquidity_surge(df: DataFrame, key="ticker", ts="session_date", volume="dollar_volume") -> DataFrame:
    """Median volume of 5 rows over the median of 61; NULL when either is missing or zero."""
    out = rolling_medians(df, volume, {"_m5": (-4, 0), "_m61": (-60, 0)}, key, ts)
    return out.withColumn("liquidity_surge", F.nullif("_m5", F.lit(0.0)) / F.nullif("_m61", F.lit(0.0))).drop("_m5", "_m61")


def log_dollar_volume(df: DataFrame, volume="dollar_volume") -> DataFrame:
    return df.withColumn("log_dollar_volume", F.when(F.col(volume) > 0, F.log10(volume)))


def return_dispersion_21d(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    return _returns(df, key, ts).withColumn(
        "return_dispersion_21d", F.max(F.abs("_r")).over(_rows(-20, 0, key, ts)))


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column and which are there."""
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(), column.is_valid().to_numpy()


def _frame(x: np.ndarray, there: np.ndarray, pos: np.ndarray, rows: int):
    """Every row's trailing frame inside its history, one place of it at a time from the oldest."""
    x, there = np.concatenate([np.zeros(rows - 1), x]), np.concatenate([np.zeros(rows - 1, bool), there])
    for k in range(rows):
        yield x[k:len(pos) + k], there[k:len(pos) + k] & (pos >= rows - 1 - k)


def _deviations(x, there, pos, rows):
    """Sample deviation by the same updates, in the same order, as ``stddev_samp`` makes."""
    n, mean, m2 = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for v, ok in _frame(x, there, pos, rows):
        n += ok
        delta = np.where(ok, v - mean, 0.0)
        step = delta / np.maximum(n, 1)
        mean, m2 = mean + step, m2 + delta * (delta - step)
    return np.sqrt(m2 / np.maximum(n - 1, 1)), n >= 2


def _averages(x, there, pos, rows):
    n, total = np.zeros(len(x)), np.zeros(len(x))
    for v, ok in _frame(x, there, pos, rows):
        n, total = n + ok, total + np.where(ok, v, 0.0)
    return total / np.maximum(n, 1), n > 0


def _counts(there, pos, rows):
    upto, at = np.concatenate([[0], np.cumsum(there)]), np.arange(len(pos))
    return upto[at + 1] - upto[at - np.minimum(pos, rows - 1)]


def _maxima(x, there, pos, rows):
    """Maxima over 1, 2, 4 ... rows, each from the one before, and the last two of them together."""
    def joined(top, back):
        earlier = np.concatenate([np.full(back, -np.inf), top])[:len(top)]
        return np.where(pos >= back, np.maximum(top, earlier), top)
    top, width = np.where(there, x, -np.inf), 1
    while 2 * width <= rows:
        top, width = joined(top, width), 2 * width
    return joined(top, rows - width) if rows > width else top, _counts(there, pos, rows) > 0


def _medians(x, there, pos, rows):
    cells = np.concatenate([np.full(rows - 1, np.nan), np.where(there, x, np.nan)])
    cells = np.where(pos[:, None] >= np.arange(rows)[::-1], np.lib.stride_tricks.sliding_window_view(cells, rows), np.nan)
    cells, n, at = np.sort(cells, axis=1), _counts(there, pos, rows), np.arange(len(x))
    return cells[at, np.maximum(n - 1, 0) // 2] * 0.5 + cells[at, np.minimum(n // 2, rows - 1)] * 0.5, n > 0


#: What ``features`` needs of trailing frames: its name, the column, the rows and the measure.
TRAILING = (("_sd", "_r", 21, _deviations), ("_sdb", "_rb", 21, _deviations), ("return_dispersion_21d", "_ra", 21, _maxima), ("_top", "close", 253, _maxima),
            ("_mean", "close", 64, _averages), ("_m5", "dollar_volume", 5, _medians), ("_m61", "dollar_volume", 61, _medians))


def trailing(df: DataFrame, measures=TRAILING, key="ticker", ts="session_date") -> DataFrame:
    """Measures over trailing frames of a fixed number of rows, for a batch of ordered rows at once. A window would go through the whole
    frame again, and build its list of values again, for each row. Equal, bit by bit, to windows over the same frames. What the
    longest frame reaches of a batch is kept for the next one, so a task holds one batch however long a history is."""
    schema = StructType(df.schema.fields + [StructField(name, DoubleType()) for name, *_ in measures])
    columns, reach = sorted({col for _, col, *_ in measures}), max(rows for _, _, rows, _ in measures) - 1

    def add(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]).select([key, *columns])
            now = now if kept is None else pa.concat_tables([kept, now])
            kept, new = now.slice(max(0, len(now) - reach)), len(now) - batch.num_rows
            codes = now.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            at = np.arange(len(codes))
            pos = at - np.maximum.accumulate(np.where(np.diff(codes, prepend=codes[:1]) != 0, at, 0))
            for name, col, rows, measure in measures:
                x, ok = measure(*_numbers(now.column(col)), pos, rows)
                batch = batch.append_column(name, pa.array(x[new:], mask=~ok[new:]))
            yield batch
    return df.repartition(key).sortWithinPartitions(key, ts).mapInArrow(add, schema)


def features(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """All eleven price features, the sorted list of missing ones, and window lengths. No gap is ever filled."""
    out = _returns(df, key, ts)
    for n in (5, policy.SHORT_WINDOW, policy.MEDIUM_WINDOW, policy.LONG_WINDOW):
        out = excess_return(out, n, key, ts)
    out = trailing(out.withColumn("_ra", F.abs("_r")), TRAILING, key, ts)
    out = (out.withColumn("volatility_21d", F.col("_sd") * ANNUAL).withColumn("volatility_ratio", ratio("_sd", "_sdb"))
           .withColumn("drawdown_252", F.col("close") / F.col("_top") - 1).withColumn("distance_63", F.col("close") / F.col("_mean") - 1)
           .withColumn("liquidity_surge", F.nullif("_m5", F.lit(0.0)) / F.nullif("_m61", F.lit(0.0))))
    out = log_dollar_volume(out)
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in policy.FEATURES])))
    return (out.drop("_r", "_rb", "_ra", "_sd", "_sdb", "_top", "_mean", "_m5", "_m61").withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)
            .withColumn("prior_sessions", F.col("idx"))
            .withColumn("window_length", F.least(F.col("idx"), F.lit(policy.LONG_WINDOW)) + 1))


def median_dollar_volume_20d(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Median of close times volume over exactly 20 rows (missing counts as 0); NULL on a shorter window."""
    value = F.coalesce(F.col("close"), F.lit(0.0)) * F.coalesce(F.col("volume"), F.lit(0.0))
    full = F.count(F.lit(1)).over(_rows(-19, 0, key, ts)) == 20
    out = rolling_medians(df.withColumn("_dv", value), "_dv", {"_m20": (-19, 0)}, key, ts)
    return out.withColumn("median_dollar_volume_20d", F.when(full, F.col("_m20"))).drop("_dv", "_m20")


def prior_sessions(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    return df.withColumn("prior_sessions", F.row_number().over(_w(key, ts)) - 1)


def _before(order):
    """All rows that come earlier in an order. Later rows are read this way too, in reversed order: a frame that ends with its
    partition is added up anew for every row, which is quadratic in the length of a history."""
    return order.rowsBetween(Window.unboundedPreceding, -1)


def later_product(df: DataFrame, factor: str, name: str, key="ticker", ts="session_date") -> DataFrame:
    """Product of ``factor`` over all strictly later rows of the key (1 where there is none), running from the last row back."""
    after = _before(Window.partitionBy(key).orderBy(F.desc(ts)))
    return df.withColumn(name, F.coalesce(F.product(F.col(factor)).over(after), F.lit(1.0)))


def total_return_adjust(bars: DataFrame, dividends: DataFrame, key="ticker", ts="session_date", mark: str | None = None) -> DataFrame:
    """Total-return close: each earlier close is scaled by (prev - cash) / prev of every later ex-date.

    Dividends are unioned into the bar rows on their ex-date, so one window pass serves the previous close, the factor
    and the reverse product; an ex-date after the last bar still scales every bar. A factor that cannot be formed makes
    every earlier close unknown instead of wrong. ``mark`` names a column that tells whether the row's own date is an ex-date.
    """
    b = bars.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_bar"),
                    F.col("close").alias("_close"), F.lit(None).cast("double").alias("_cash"))
    d = dividends.select(key, F.col("event_date").alias("_t"), F.lit(0).alias("_side"),
                         F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar"),
                         F.lit(None).cast("double").alias("_close"), F.col("cash").alias("_cash"))
    order = Window.partitionBy(key).orderBy("_t", "_side")
    prev = F.last("_close", ignorenulls=True).over(_before(order))
    usable = (F.col("_cash") >= 0) & (F.col("_prev") > F.col("_cash"))
    later = _before(Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")))
    out = (b.unionByName(d).withColumn("_prev", prev)
           .withColumn("_f", F.when(F.col("_side") == 1, F.lit(None).cast("double"))
                       .otherwise(F.when(usable, (F.col("_prev") - F.col("_cash")) / F.col("_prev"))))
           .withColumn("_bad", F.when(F.col("_side") == 0, (F.col("_f").isNull() | (F.col("_f") <= 0)).cast("int")))
           .withColumn("adj_factor", F.coalesce(F.product("_f").over(later), F.lit(1.0)))
           .withColumn("dividends_clean", F.coalesce(F.max("_bad").over(later), F.lit(0)) == 0))
    if mark:
        paid = F.last(F.when(F.col("_side") == 0, F.col("_t")), ignorenulls=True).over(_before(order))
        out = out.withColumn(mark, F.coalesce(paid == F.col("_t"), F.lit(False)))
    return (out.filter(F.col("_side") == 1).select("_bar.*", "adj_factor", "dividends_clean", *[mark] * bool(mark))
            .withColumn("adjusted_close", F.when(F.col("dividends_clean"), F.col("close") * F.col("adj_factor"))))


def split_share_factor(df: DataFrame, splits: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Product of the split ratios dated strictly after each row, by one pass over rows and splits together."""
    b = df.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"),
                  F.lit(None).cast("double").alias("_ratio"))
    s = splits.select(key, F.col("split_date").alias("_t"), F.lit(0).alias("_side"),
                      F.lit(None).cast(b.schema["_row"].dataType).alias("_row"), F.col("split_ratio").alias("_ratio"))
    later = _before(Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")))
    return (b.unionByName(s).withColumn("split_share_factor", F.coalesce(F.product("_ratio").over(later), F.lit(1.0)))
            .filter("_side = 1").select("_row.*", "split_share_factor"))


def factor_adjust_history(closes: DataFrame, factors: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Closes times every active factor with a later ex-date; a later 'R' message cancels the 'A' of the same event."""
    final = (factors.groupBy(key, "event_id", "ex_date")
             .agg(F.max_by(F.struct("status", "factor"), "arrival").alias("l")).filter("l.status = 'A'")
             .select(key, F.col("ex_date").alias("split_date"), F.col("l.factor").alias("split_ratio")))
    out = split_share_factor(closes, final, key, ts)
    return (out.withColumn("adjusted_close", F.col("close") * F.col("split_share_factor"))
            .withColumnRenamed("split_share_factor", "price_factor"))


def outcome_sessions(df: DataFrame, horizon: int, key="ticker", ts="session_date") -> DataFrame:
    """Session-horizon outcome: enter one row later, leave ``horizon`` rows after; NULL past the end or if any row on
    the way is unclean."""
    w = _w(key, ts)
    entry, leave = F.lead("close", 1).over(w), F.lead("close", 1 + horizon).over(w)
    b_entry, b_leave = F.lead("bench_close", 1).over(w), F.lead("bench_close", 1 + horizon).over(w)
    ok = F.bool_and("clean").over(_rows(0, 1 + horizon, key, ts)) & leave.isNotNull()
    stock, bench = leave / entry - 1, b_leave / b_entry - 1
    trough = F.min("close").over(_rows(1, 1 + horizon, key, ts)) / entry - 1
    return (df.withColumn("stock_return", F.when(ok, stock)).withColumn("benchmark_return", F.when(ok, bench))
            .withColumn("excess_return", F.when(ok, stock - bench)).withColumn("max_drawdown", F.when(ok, trough))
            .withColumn("entry_date", F.when(ok, F.lead(ts, 1).over(w)))
            .withColumn("exit_date", F.when(ok, F.lead(ts, 1 + horizon).over(w))))


def forward_move(df: DataFrame, horizon: int = policy.RADAR_HORIZON, key="ticker", ts="session_date") -> DataFrame:
    w = _w(key, ts)
    stock = F.lead("close", horizon).over(w) / F.col("close") - 1
    bench = F.lead("bench_close", horizon).over(w) / F.col("bench_close") - 1
    return df.withColumn("forward_move", F.abs(stock - bench))


def radar_vol_pop(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Population deviation of 21 returns, annualised; defined from the 22nd row on."""
    sd = F.stddev_pop("_r").over(_rows(-20, 0, key, ts)) * ANNUAL
    return _returns(df, key, ts).withColumn("radar_vol_pop", F.when(F.col("idx") >= policy.SHORT_WINDOW, sd))


def radar_vol_current(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Population deviation over the last 22 closes; NULL with fewer than 10 closes."""
    sd = F.stddev_pop("_r").over(_rows(-20, 0, key, ts)) * ANNUAL
    return _returns(df, key, ts).withColumn("radar_vol_current", F.when(F.col("idx") >= 9, sd))


def volume_build(df: DataFrame, key="ticker", ts="session_date", volume="dollar_volume") -> DataFrame:
    enough = F.count(volume).over(_rows(-60, 0, key, ts)) >= 20
    out = rolling_medians(df, volume, {"_m5": (-4, 0), "_m61": (-60, 0)}, key, ts)
    return out.withColumn("volume_build", F.when(enough, F.col("_m5") / F.nullif("_m61", F.lit(0.0)))).drop("_m5", "_m61")


def results_due_next5(df: DataFrame, announcements: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Whether any of the next five session rows carries an announcement date."""
    flagged = df.join(announcements.select(key, F.col("event_date").alias(ts)).distinct()
                      .withColumn("_due", F.lit(1)), [key, ts], "left")
    due = F.max("_due").over(_rows(1, 5, key, ts))
    return flagged.withColumn("results_due_next5", F.coalesce(due, F.lit(0)) == 1).drop("_due")


def session_moves(df: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Daily move against the benchmark in percent."""
    return df.withColumn("session_move", (_change("close", 1, key, ts) - _change("bench_close", 1, key, ts)) * 100)


def mover_features(bars: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Measurements that end on the previous row, so the move of the row itself is never part of them."""
    w = _w(key, ts)
    log_r = F.log(F.col("close") / F.lag("close").over(w))
    prior20 = _rows(-20, -1, key, ts)
    out = (bars.withColumn("_dv", F.col("close") * F.col("volume")).withColumn("_lr", log_r)
           .withColumn("prior_rows", F.row_number().over(w) - 1))
    out = rolling_medians(out, "_dv", {"median_dollar_volume": (-20, -1), "_late": (-5, -1), "_early": (-20, -6)}, key, ts)
    return (out.withColumn("return_5d", F.lag("close", 1).over(w) / F.lag("close", 6).over(w) - 1)
            .withColumn("return_20d", F.lag("close", 1).over(w) / F.lag("close", 21).over(w) - 1)
            .withColumn("volume_build", ratio("_late", F.when(F.col("prior_rows") >= 6, F.col("_early"))))
            .withColumn("log_volatility", F.when(F.count("_lr").over(prior20) >= 10,
                                                 F.stddev_samp("_lr").over(prior20) * ANNUAL))
            .withColumn("volume_multiple", ratio("_dv", "median_dollar_volume")).drop("_dv", "_lr", "_late", "_early"))


def running_wealth(df: DataFrame, ret: str = "ret", key="symbol", ts="month") -> DataFrame:
    """Compounded wealth, its running peak (never below the starting 1.0) and the drawdown from it."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    return (out.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
            .withColumn("running_drawdown", F.col("wealth") / F.col("peak") - 1))


def rolling_product(df: DataFrame, n: int = 24, ret: str = "ret", key="symbol", ts="month",
                    name: str = "rolling_24m_return") -> DataFrame:
    """Compounded return of exactly ``n`` rows; NULL on a shorter window."""
    f = Window.partitionBy(key).orderBy(ts).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(f) == n
    return df.withColumn(name, F.when(full, F.product(1 + F.col(ret)).over(f) - 1))
