"""Queries over bar scans and window columns."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import frames
from tidemark.sources import bars as src

W = "(PARTITION BY ticker ORDER BY session_date {})"


def _rows(a, b=0):
    def side(x):
        return "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return W.format(f"ROWS BETWEEN {side(a)} AND {side(b)}")


ROW = W.format("")
LATER = W.format("ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING")
KEY = "ticker:s session_date:d "


@query("scan_bars", KEY + "close:f high:f low:f volume:f trades:l clean:b", """
SELECT * FROM bars WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def _(v):
    return src.scan_bars(v.bars, "1996-01-01", "1997-12-31")


@query("scan_observations", KEY + "security_id:s close:f bench_close:f clean:b policy_version:s", """
SELECT *, '2026.08.02.1' AS policy_version FROM obs WHERE session_date >= DATE '1999-01-01'""")
def _(v):
    return src.scan_observations(v.obs.withColumn("policy_version", F.lit("2026.08.02.1")), "1999-01-01", None,
                                 "2026.08.02.1")


@query("scan_histories", KEY + "idx:l n:l close:f bench_close:f dollar_volume:f4", "SELECT * FROM hist")
def _(v):
    return v.hist


@query("latest_close", KEY + "close:f", """
SELECT ticker, max(session_date) AS session_date, arg_max(close, session_date) AS close FROM bars WHERE close > 0 GROUP BY ticker""")
def _(v):
    return src.latest_close(v.bars)


@view("calendar_log", """
SELECT session_date, CASE WHEN count(*) >= 20 THEN 'complete' WHEN count(*) >= 15 THEN 'no_data' ELSE 'partial' END AS status
FROM bars GROUP BY session_date""")
def _log(v):
    n = F.count(F.lit(1))
    return v.bars.groupBy("session_date").agg(
        F.when(n >= 20, "complete").when(n >= 15, "no_data").otherwise("partial").alias("status"))


SQL_MISSING = """
SELECT CAST(d AS DATE) AS session_date FROM (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2002-06-30', INTERVAL 1 DAY)) AS d)
WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT session_date FROM calendar_log WHERE status IN ('complete','no_data'))"""


@query("completed_dates", "session_date:d", SQL_MISSING)
def _(v):
    return src.missing_sessions(v.calendar_log, "1995-01-02", "2002-06-30")


@view("price_feed", """
SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice/l_quantity AS close,
  CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice/l_quantity*(1e0-l_discount) END AS adjusted_close,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice/l_quantity*(1e0-l_discount) END AS quote,
  l_orderkey*1000000 + l_partkey*10 + l_linenumber + l_extendedprice/1e7 AS arrival FROM lineitem""")
def _feed(v):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    off = px * (1.0 - F.col("l_discount"))
    return v.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("session_date"),
        px.alias("close"), F.when(F.col("l_linenumber") % 2 == 0, off).alias("adjusted_close"),
        F.when(F.col("l_linenumber") % 3 != 0, off).alias("quote"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
         + F.col("l_extendedprice") / 1e7).alias("arrival"))


@query("price_points", "ticker:s points:l first_price:f last_price:f quote:f period_return:f cross_checked:b", """
SELECT ticker, count(*) AS points, arg_min(price, session_date) AS first_price, arg_max(price, session_date) AS last_price,
  arg_max_null(quote, session_date) AS quote, arg_max(price, session_date)/arg_min(price, session_date)-1 AS period_return,
  CASE WHEN arg_max_null(quote, session_date) > 0 THEN abs(arg_max(price, session_date)/arg_max_null(quote, session_date)-1) <= 0.05e0 END AS cross_checked
FROM (SELECT ticker, session_date, arg_max(coalesce(adjusted_close, close), arrival) AS price, arg_max_null(quote, arrival) AS quote
      FROM price_feed WHERE coalesce(adjusted_close, close) > 0 GROUP BY 1, 2) GROUP BY ticker""")
def _(v):
    return src.price_points(v.price_feed)


@query("daily_return", KEY + "daily_return:f", f"SELECT *, close/lag(close) OVER {ROW}-1 AS daily_return FROM hist")
def _(v):
    return frames.daily_return(v.hist)


for _n in (5, 21, 63, 126):
    @query(f"excess_return_{_n}", KEY + f"excess_return_{_n}d:f", f"""
SELECT *, (close/lag(close,{_n}) OVER {ROW}-1) - (bench_close/lag(bench_close,{_n}) OVER {ROW}-1) AS excess_return_{_n}d FROM hist""")
    def _(v, n=_n):
        return frames.excess_return(v.hist, n)

CTE_RET = f"SELECT *, close/lag(close) OVER {ROW}-1 AS r, bench_close/lag(bench_close) OVER {ROW}-1 AS rb FROM hist"


@view("rets", CTE_RET)
def _rets(v):
    return frames._returns(v.hist, "ticker", "session_date").withColumnsRenamed({"_r": "r", "_rb": "rb"})


@query("volatility_21d", KEY + "volatility_21d:f",
       f"SELECT *, stddev_samp(r) OVER {_rows(-20)}*sqrt(252e0) AS volatility_21d FROM rets")
def _(v):
    return frames.volatility_21d(v.hist)


@query("volatility_ratio", KEY + "volatility_ratio:f",
       f"SELECT *, stddev_samp(r) OVER {_rows(-20)}/nullif(stddev_samp(rb) OVER {_rows(-20)},0) AS volatility_ratio FROM rets")
def _(v):
    return frames.volatility_ratio(v.hist)


@query("drawdown_252", KEY + "drawdown_252:f",
       f"SELECT *, close/max(close) OVER {_rows(-252)}-1 AS drawdown_252 FROM hist")
def _(v):
    return frames.drawdown_252(v.hist)


@query("distance_63", KEY + "distance_63:f",
       f"SELECT *, close/avg(close) OVER {_rows(-63)}-1 AS distance_63 FROM hist")
def _(v):
    return frames.distance_63(v.hist)


@query("liquidity_surge", KEY + "liquidity_surge:f", f"""
SELECT *, nullif(quantile_cont(dollar_volume,0.5) OVER {_rows(-4)},0)/nullif(quantile_cont(dollar_volume,0.5) OVER {_rows(-60)},0) AS liquidity_surge FROM hist""")
def _(v):
    return frames.liquidity_surge(v.hist)


@query("log_dollar_volume", KEY + "log_dollar_volume:f",
       "SELECT *, CASE WHEN dollar_volume>0 THEN log10(dollar_volume) END AS log_dollar_volume FROM hist")
def _(v):
    return frames.log_dollar_volume(v.hist)


@query("return_dispersion_21d", KEY + "return_dispersion_21d:f",
       f"SELECT *, max(abs(r)) OVER {_rows(-20)} AS return_dispersion_21d FROM rets")
def _(v):
    return frames.return_dispersion_21d(v.hist)


_EX = ", ".join(f"(close/lag(close,{n}) OVER {ROW}-1)-(bench_close/lag(bench_close,{n}) OVER {ROW}-1) AS excess_return_{n}d"
                for n in (5, 21, 63, 126))
_NAMES = ("excess_return_5d excess_return_21d excess_return_63d excess_return_126d volatility_21d volatility_ratio drawdown_252 "
          "distance_63 liquidity_surge log_dollar_volume return_dispersion_21d").split()


@view("feats", f"""
SELECT *, least(idx,126)+1 AS window_length, idx AS prior_sessions,
  list_sort(list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _NAMES)}], lambda x: x IS NOT NULL)) AS missing,
  {" AND ".join(f"{c} IS NOT NULL" for c in _NAMES)} AS complete
FROM (SELECT *, {_EX}, stddev_samp(r) OVER {_rows(-20)}*sqrt(252e0) AS volatility_21d,
  stddev_samp(r) OVER {_rows(-20)}/nullif(stddev_samp(rb) OVER {_rows(-20)},0) AS volatility_ratio,
  close/max(close) OVER {_rows(-252)}-1 AS drawdown_252, close/avg(close) OVER {_rows(-63)}-1 AS distance_63,
  nullif(quantile_cont(dollar_volume,0.5) OVER {_rows(-4)},0)/nullif(quantile_cont(dollar_volume,0.5) OVER {_rows(-60)},0) AS liquidity_surge,
  CASE WHEN dollar_volume>0 THEN log10(dollar_volume) END AS log_dollar_volume,
  max(abs(r)) OVER {_rows(-20)} AS return_dispersion_21d FROM rets)""")
def _feats(v):
    return frames.features(v.hist)


@query("features", KEY + " ".join(f"{c}:f" for c in _NAMES) + " missing_names:s complete:b window_length:l",
       "SELECT *, array_to_string(missing, ',') AS missing_names FROM feats")
def _(v):
    return v.feats.withColumn("missing_names", F.array_join("missing", ","))


@query("median_dollar_volume_20d", KEY + "median_dollar_volume_20d:f4", f"""
SELECT *, CASE WHEN count(*) OVER {_rows(-19)}=20 THEN quantile_cont(coalesce(close,0)*coalesce(volume,0),0.5) OVER {_rows(-19)} END
  AS median_dollar_volume_20d FROM bars""")
def _(v):
    return frames.median_dollar_volume_20d(v.bars)


@query("prior_sessions", KEY + "prior_sessions:l", f"SELECT *, row_number() OVER {ROW}-1 AS prior_sessions FROM bars")
def _(v):
    return frames.prior_sessions(v.bars)


CTES_TR = """
SELECT ticker, session_date, close, coalesce(product(f) FILTER (WHERE side=0) OVER w, 1e0) AS adj_factor,
  coalesce(max(CASE WHEN side=0 AND (f IS NULL OR f<=0) THEN 1 WHEN side=0 THEN 0 END) OVER w, 0)=0 AS dividends_clean, side, clean, volume
FROM (SELECT *, CASE WHEN side=0 AND cash>=0 AND prev>cash THEN (prev-cash)/prev END AS f
  FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session_date, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM (SELECT ticker, session_date, close, NULL AS cash, 1 AS side, clean, volume FROM bars
          UNION ALL SELECT ticker, event_date, NULL, cash, 0, NULL, NULL FROM dividends)))
WINDOW w AS (PARTITION BY ticker ORDER BY session_date, side ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


@view("total_return", f"""
SELECT *, CASE WHEN dividends_clean THEN close*adj_factor END AS adjusted_close FROM ({CTES_TR}) WHERE side=1""")
def _tr(v):
    return frames.total_return_adjust(v.bars, v.dividends)


@query("adj_factor", KEY + "adj_factor:f dividends_clean:b adjusted_close:f", "SELECT * FROM total_return")
def _(v):
    return v.total_return


@query("range_actions_join", KEY + "adjusted_close:f", """
SELECT b.ticker, b.session_date, CASE WHEN count(CASE WHEN d.event_date IS NOT NULL AND d.f IS NULL THEN 1 END)=0
  THEN any_value(b.close)*coalesce(product(d.f),1e0) END AS adjusted_close
FROM bars b LEFT JOIN (
  SELECT d.ticker, d.event_date, CASE WHEN d.cash>=0 AND p.close>d.cash THEN (p.close-d.cash)/p.close END AS f
  FROM dividends d ASOF LEFT JOIN bars p ON d.ticker=p.ticker AND d.event_date > p.session_date) d
ON b.ticker=d.ticker AND d.event_date > b.session_date GROUP BY b.ticker, b.session_date""")
def _(v):
    return frames.total_return_adjust(v.bars, v.dividends)


@query("split_share_factor", KEY + "split_share_factor:f", """
SELECT b.ticker, b.session_date, coalesce(product(s.split_ratio),1e0) AS split_share_factor FROM bars b
LEFT JOIN splits s ON b.ticker=s.ticker AND s.split_date > b.session_date GROUP BY 1, 2""")
def _(v):
    return frames.split_share_factor(v.bars, v.splits)


@view("factor_log", """
SELECT ticker, 'E' || year(split_date) AS event_id, split_date AS ex_date, a AS arrival,
  CASE WHEN a = 2 AND year(split_date) % 4 = 1 THEN 'R' ELSE 'A' END AS status, split_ratio*a/2e0 AS factor
FROM splits, (SELECT unnest([1,2]) AS a)""")
def _flog(v):
    a = F.col("arrival")
    return (v.splits.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "ticker", F.concat(F.lit("E"), F.year("split_date")).alias("event_id"), F.col("split_date").alias("ex_date"), "arrival",
        F.when((a == 2) & (F.year("split_date") % 4 == 1), "R").otherwise("A").alias("status"),
        (F.col("split_ratio") * a / 2.0).alias("factor")))


@query("factor_adjust_history", KEY + "price_factor:f adjusted_close:f4", """
SELECT b.ticker, b.session_date, coalesce(product(f.factor),1e0) AS price_factor, any_value(b.close)*coalesce(product(f.factor),1e0) AS adjusted_close
FROM bars b LEFT JOIN (SELECT ticker, ex_date, factor FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_id, ex_date ORDER BY arrival DESC) AS rn FROM factor_log)
  WHERE rn=1 AND status='A') f ON b.ticker=f.ticker AND f.ex_date > b.session_date GROUP BY 1, 2""")
def _(v):
    return frames.factor_adjust_history(v.bars, v.factor_log)


def outcome_sql(h):
    return f"""
SELECT *, CASE WHEN ok THEN sr END AS stock_return, CASE WHEN ok THEN br END AS benchmark_return, CASE WHEN ok THEN sr-br END AS excess_return,
  CASE WHEN ok THEN dd END AS max_drawdown, CASE WHEN ok THEN en END AS entry_date, CASE WHEN ok THEN ex END AS exit_date
FROM (SELECT *, lead(close,{1 + h}) OVER {ROW}/lead(close,1) OVER {ROW}-1 AS sr, lead(bench_close,{1 + h}) OVER {ROW}/lead(bench_close,1) OVER {ROW}-1 AS br,
  min(close) OVER {_rows(1, 1 + h)}/lead(close,1) OVER {ROW}-1 AS dd, lead(session_date,1) OVER {ROW} AS en, lead(session_date,{1 + h}) OVER {ROW} AS ex,
  bool_and(clean) OVER {_rows(0, 1 + h)} AND lead(close,{1 + h}) OVER {ROW} IS NOT NULL AS ok FROM feats)"""


for _h in (1, 5, 21):
    @query(f"outcome_sessions_{_h}", KEY + "entry_date:d exit_date:d stock_return:f benchmark_return:f excess_return:f max_drawdown:f",
           outcome_sql(_h).replace("feats", "hist"))
    def _(v, h=_h):
        return frames.outcome_sessions(v.hist, h)

FWD = f"abs((lead(close,5) OVER {ROW}/close-1)-(lead(bench_close,5) OVER {ROW}/bench_close-1))"


@query("forward_move", KEY + "forward_move:f t3:b t5:b t7_5:b t10:b", f"""
SELECT *, m AS forward_move, m>=0.03e0 AS t3, m>=0.05e0 AS t5, m>=0.075e0 AS t7_5, m>=0.1e0 AS t10 FROM (SELECT *, {FWD} AS m FROM hist)""")
def _(v):
    m = F.col("forward_move")
    return (frames.forward_move(v.hist).withColumn("t3", m >= 0.03).withColumn("t5", m >= 0.05)
            .withColumn("t7_5", m >= 0.075).withColumn("t10", m >= 0.10))


@query("radar_vol_pop", KEY + "radar_vol_pop:f",
       f"SELECT *, CASE WHEN idx>=21 THEN stddev_pop(r) OVER {_rows(-20)}*sqrt(252e0) END AS radar_vol_pop FROM rets")
def _(v):
    return frames.radar_vol_pop(v.hist)


@query("radar_vol_current", KEY + "radar_vol_current:f",
       f"SELECT *, CASE WHEN idx>=9 THEN stddev_pop(r) OVER {_rows(-20)}*sqrt(252e0) END AS radar_vol_current FROM rets")
def _(v):
    return frames.radar_vol_current(v.hist)


@query("volume_build", KEY + "volume_build:f", f"""
SELECT *, CASE WHEN count(dollar_volume) OVER {_rows(-60)}>=20 THEN quantile_cont(dollar_volume,0.5) OVER {_rows(-4)}/
  nullif(quantile_cont(dollar_volume,0.5) OVER {_rows(-60)},0) END AS volume_build FROM hist""")
def _(v):
    return frames.volume_build(v.hist)


@query("results_due_next5", KEY + "results_due_next5:b", f"""
SELECT h.ticker, h.session_date, coalesce(max(CASE WHEN e.event_date IS NOT NULL THEN 1 END) OVER (PARTITION BY h.ticker ORDER BY h.session_date
  ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),0)=1 AS results_due_next5
FROM hist h LEFT JOIN (SELECT DISTINCT ticker, event_date FROM iev WHERE event_type='results') e ON h.ticker=e.ticker AND h.session_date=e.event_date""")
def _(v):
    return frames.results_due_next5(v.hist, v.iev.filter("event_type = 'results'"))


@query("session_moves", KEY + "session_move:f", "SELECT *, (r-rb)*100 AS session_move FROM rets")
def _(v):
    return frames.session_moves(v.hist)


MOVER_SQL = f"""
SELECT *, CASE WHEN earlier>0 THEN recent/earlier END AS volume_build, CASE WHEN nl>=10 THEN sl*sqrt(252e0) END AS log_volatility,
  dv/nullif(median_dollar_volume,0) AS volume_multiple
FROM (SELECT *, lag(close,1) OVER {ROW}/lag(close,6) OVER {ROW}-1 AS return_5d, lag(close,1) OVER {ROW}/lag(close,21) OVER {ROW}-1 AS return_20d,
  quantile_cont(dv,0.5) OVER {_rows(-20, -1)} AS median_dollar_volume, quantile_cont(dv,0.5) OVER {_rows(-5, -1)} AS recent,
  quantile_cont(dv,0.5) OVER {_rows(-20, -6)} AS earlier, count(lr) OVER {_rows(-20, -1)} AS nl, stddev_samp(lr) OVER {_rows(-20, -1)} AS sl
  FROM (SELECT *, close*volume AS dv, ln(close/lag(close) OVER {ROW}) AS lr, row_number() OVER {ROW}-1 AS prior_rows FROM bars))"""


@view("mover_frame", MOVER_SQL)
def _mf(v):
    return frames.mover_features(v.bars)


@query("mover_features", KEY + "prior_rows:l return_5d:f return_20d:f median_dollar_volume:f4 volume_build:f log_volatility:f volume_multiple:f",
       "SELECT * FROM mover_frame")
def _(v):
    return v.mover_frame
