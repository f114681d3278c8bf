"""Queries over portfolio analytics. Assets are the 25 supplier nations; portfolios are the customers."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import blockmatrix, frames, portfolio as pf
from tidemark.session import reliable_checkpoint

ANCHORS, RESERVE = ["1", "5", "9"], ["3"]


@view("asset_prices", """
SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session_date,
 CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100e0/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def _prices(v):
    li = v.table("lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    j = li.join(v.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("s_nationkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("session_date")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 100.0 / F.sum(F.col("l_quantity").cast("bigint")).cast("double")).alias("close"))


@view("monthly", """
SELECT * FROM (SELECT symbol, month, month_close, month_close/lag(month_close) OVER (PARTITION BY symbol ORDER BY month)-1 AS ret FROM (
 SELECT symbol, CAST(date_trunc('month', session_date) AS DATE) AS month, arg_max(close, session_date) AS month_close FROM asset_prices GROUP BY 1, 2)) WHERE ret IS NOT NULL""")
def _monthly(v):
    return pf.month_end_returns(v.asset_prices)


@query("month_end_returns", "symbol:s month:d month_close:f ret:f", "SELECT * FROM monthly")
def _(v):
    return v.monthly


@view("market", """
SELECT * FROM (SELECT month, c/lag(c) OVER (ORDER BY month)-1 AS ret FROM (SELECT CAST(date_trunc('month', session_date) AS DATE) AS month, arg_max(bench_close, session_date) AS c FROM bench GROUP BY 1)) WHERE ret IS NOT NULL""")
def _market(v):
    b = v.bench.select(F.lit("market").alias("symbol"), "session_date", F.col("bench_close").alias("close"))
    return pf.month_end_returns(b).select("month", "ret")


@query("benchmark_metrics", "periods:l annual_return:f max_drawdown:f", """
SELECT count(*) AS periods, pow(product(1+ret), 12e0/count(*))-1 AS annual_return, least(0, min(dd)) AS max_drawdown FROM (
 SELECT *, wealth/greatest(1e0, max(wealth) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING))-1 AS dd FROM (SELECT *, product(1+ret) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS wealth FROM market
  WHERE month IN (SELECT month FROM monthly GROUP BY month HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM monthly))))""")
def _(v):
    from tidemark.operators.sets import common_months
    m = v.market.join(common_months(v.monthly), "month", "left_semi").withColumn("symbol", F.lit("market"))
    return pf.path_metrics(m)


@query("common_calendar", "symbol:s month:d ret:f", """
SELECT * FROM monthly WHERE month IN (SELECT month FROM monthly GROUP BY month HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM monthly)) AND month IN (SELECT month FROM market)""")
def _(v):
    from tidemark.operators.sets import common_months
    return v.monthly.join(common_months(v.monthly), "month", "left_semi").join(v.market.select("month"), "month", "left_semi")


PATH = """
SELECT symbol, count(*) AS periods, pow(product(1+ret), 12e0/count(*))-1 AS annual_return, coalesce(stddev_samp(ret),0)*sqrt(12e0) AS annual_volatility,
 least(0, min(dd)) AS max_drawdown, min(roll) AS worst_window, max(roll) AS best_window, avg(ret) FILTER (WHERE rk <= greatest(1, ceil(n*0.05e0))) AS cvar95
FROM (SELECT *, wealth/greatest(1e0, max(wealth) OVER w)-1 AS dd FROM (
 SELECT *, product(1+ret) OVER w AS wealth, CASE WHEN count(*) OVER w24 = 24 THEN product(1+ret) OVER w24 - 1 END AS roll, row_number() OVER (PARTITION BY symbol ORDER BY ret, month) AS rk, count(*) OVER (PARTITION BY symbol) AS n
 FROM monthly WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING), w24 AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
 WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING)) GROUP BY symbol"""


@query("path_metrics", "symbol:s periods:l annual_return:f annual_volatility:f max_drawdown:f worst_window:f best_window:f cvar95:f", PATH)
def _(v):
    return pf.path_metrics(v.monthly)


@query("rolling_24m_return", "symbol:s month:d rolling_24m_return:f", """
SELECT *, CASE WHEN count(*) OVER w = 24 THEN product(1+ret) OVER w - 1 END AS rolling_24m_return FROM monthly WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(v):
    return frames.rolling_product(v.monthly)


@query("running_drawdown", "symbol:s month:d wealth:f peak:f running_drawdown:f", """
SELECT *, wealth/peak-1 AS running_drawdown FROM (SELECT *, greatest(1e0, max(wealth) OVER w) AS peak FROM (SELECT *, product(1+ret) OVER w AS wealth FROM monthly WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING))
 WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING))""")
def _(v):
    return frames.running_wealth(v.monthly)


@query("information_ratio", "symbol:s information_ratio:f", "SELECT symbol, avg(m.ret-k.ret)/stddev_samp(m.ret-k.ret)*sqrt(12e0) AS information_ratio FROM monthly m JOIN market k USING (month) GROUP BY 1")
def _(v):
    j = v.monthly.join(v.market.select("month", F.col("ret").alias("m")), "month")
    return pf.information_ratio(j, "ret", "m", ["symbol"])


@query("beta", "symbol:s months:l ready:b raw_beta:f used_beta:f", """
SELECT symbol, n AS months, n >= 36 AND b IS NOT NULL AS ready, CASE WHEN n >= 36 THEN b END AS raw_beta, CASE WHEN n >= 36 AND b IS NOT NULL THEN least(1.6, greatest(0.8, b)) END AS used_beta FROM (
 SELECT symbol, count(*) AS n, regr_slope(r, mr) AS b FROM (SELECT symbol, m.ret AS r, k.ret AS mr, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) AS i FROM monthly m JOIN market k USING (month)) WHERE i <= 60 GROUP BY 1)""")
def _(v):
    return pf.beta(v.monthly, v.market)


@view("asset_daily", "SELECT * FROM (SELECT symbol, session_date, close/lag(close) OVER (PARTITION BY symbol ORDER BY session_date)-1 AS ret FROM asset_prices) WHERE ret IS NOT NULL")
def _daily(v):
    return frames.daily_return(v.asset_prices, key="symbol", name="ret").filter("ret IS NOT NULL")


@view("pair_stats", """
SELECT l.symbol AS "left", r.symbol AS "right", count(*) AS observations, CASE WHEN count(*) >= 40 THEN greatest(-1, least(1, corr(l.ret, r.ret))) END AS correlation,
 CASE WHEN count(*) >= 40 THEN covar_samp(l.ret, r.ret)*252 END AS covariance FROM asset_daily l JOIN asset_daily r USING (session_date) GROUP BY 1, 2""")
def _pairs(v):
    return pf.pairwise_stats(v.asset_daily)


def _lr(df):
    return df.withColumnsRenamed({"left": "left_symbol", "right": "right_symbol"})


@query("correlation_matrix", "left_symbol:s right_symbol:s observations:l correlation:f covariance:f", 'SELECT "left" AS left_symbol, "right" AS right_symbol, * FROM pair_stats')
def _(v):
    return _lr(v.pair_stats)


@query("pairwise_common_dates", "left_symbol:s right_symbol:s observations:l", 'SELECT "left" AS left_symbol, "right" AS right_symbol, observations FROM pair_stats')
def _(v):
    return _lr(v.pair_stats)


@query("strongest_pair", "left_symbol:s right_symbol:s correlation:f", 'SELECT "left" AS left_symbol, "right" AS right_symbol, correlation FROM pair_stats WHERE "left" < "right" AND correlation IS NOT NULL ORDER BY correlation DESC, 1 DESC, 2 DESC LIMIT 1')
def _(v):
    return _lr(pf.strongest_pair(v.pair_stats))


@view("cov", """
SELECT l.symbol AS "left", r.symbol AS "right", covar_samp(l.ret, r.ret)*CASE WHEN l.symbol = r.symbol THEN 1 ELSE 0.5 END AS cov FROM monthly l JOIN monthly r USING (month) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _cov(v):
    return pf.covariance(v.monthly)


@query("covariance_shrunk", "left_symbol:s right_symbol:s cov:f", 'SELECT "left" AS left_symbol, "right" AS right_symbol, cov FROM cov')
def _(v):
    return _lr(v.cov)


@view("means", """
SELECT symbol, CASE WHEN symbol = '3' THEN own ELSE 0.9*c + 0.1*own END AS mu FROM (SELECT symbol, avg(ret)*12 AS own FROM monthly GROUP BY 1),
 (SELECT coalesce(median(own), 0.06) AS c FROM (SELECT symbol, avg(ret)*12 AS own FROM monthly GROUP BY 1) WHERE symbol IN ('1','5','9'))""")
def _means(v):
    return pf.robust_means(v.monthly, ANCHORS, RESERVE)


@query("robust_means", "symbol:s mu:f", "SELECT * FROM means")
def _(v):
    return v.means


# --- portfolios ------------------------------------------------------------------------------------------------------

@view("weights", """
SELECT portfolio, symbol, spent/sum(spent) OVER (PARTITION BY portfolio)*100 AS weight FROM (
 SELECT 'P' || o_custkey AS portfolio, CAST(s_nationkey AS VARCHAR) AS symbol, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE) AS spent
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""")
def _weights(v):
    j = (v.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(v.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(v.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    spent = j.groupBy(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("portfolio"), F.col("s_nationkey").cast("string").alias("symbol")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("spent"))
    total = spent.groupBy("portfolio").agg(F.sum("spent").alias("total"))
    return spent.join(total, "portfolio").select("portfolio", "symbol", (F.col("spent") / F.col("total") * 100).alias("weight"))


@query("portfolio_returns", "portfolio:s month:d ret:f", """
SELECT portfolio, month, sum(weight/100*ret) AS ret FROM weights JOIN monthly USING (symbol)
WHERE month IN (SELECT month FROM monthly GROUP BY month HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM monthly)) GROUP BY 1, 2""")
def _(v):
    return pf.portfolio_returns(v.weights, v.monthly)


VAR = """SELECT a.portfolio, sum(a.weight/100*b.weight/100*c.cov) AS variance FROM weights a JOIN weights b ON a.portfolio = b.portfolio JOIN cov c ON c."left" = a.symbol AND c."right" = b.symbol GROUP BY 1"""


@query("portfolio_variance", "portfolio:s variance:f", VAR)
def _(v):
    return blockmatrix.variances(blockmatrix.held_products(v.weights, v.cov))


@query("risk_contribution", "portfolio:s symbol:s risk_contribution:f", f"""
SELECT m.portfolio, m.symbol, any_value(m.weight)/100*sum(b.weight/100*c.cov)/any_value(q.variance)*100 AS risk_contribution
FROM weights m JOIN weights b ON m.portfolio = b.portfolio JOIN cov c ON c."left" = m.symbol AND c."right" = b.symbol JOIN ({VAR}) q ON q.portfolio = m.portfolio WHERE variance > 0 GROUP BY 1, 2""")
def _(v):
    return blockmatrix.contributions(reliable_checkpoint(blockmatrix.held_products(v.weights, v.cov)))


@query("avg_correlation", "portfolio:s symbol:s average_correlation:f", """
SELECT m.portfolio, m.symbol, sum(b.weight*c.correlation)/sum(CASE WHEN c.correlation IS NOT NULL THEN b.weight END) AS average_correlation
FROM weights m LEFT JOIN weights b ON m.portfolio = b.portfolio AND m.symbol <> b.symbol LEFT JOIN pair_stats c ON c."left" = m.symbol AND c."right" = b.symbol GROUP BY 1, 2""")
def _(v):
    return pf.average_correlation(v.weights, v.pair_stats, pf.asset_list(v.asset_daily, "symbol"))


@view("scored", f"""
SELECT w.portfolio, expected, variance, expected - 0.625*greatest(0, variance) AS utility, big <= 40 AS feasible FROM (SELECT portfolio, sum(weight/100*mu) AS expected, max(weight) AS big FROM weights JOIN means USING (symbol) GROUP BY 1) w JOIN ({VAR}) q USING (portfolio)""")
def _scored(v):
    bounds = v.means.select("symbol", F.lit(0.0).alias("low"), F.lit(40.0).alias("high"), F.lit("all").alias("group"))
    return pf.score_portfolios(v.weights, v.means, v.cov, bounds, {"all": (99.0, 101.0)})


@query("score_portfolios", "portfolio:s expected:f variance:f utility:f feasible:b", "SELECT * FROM scored")
def _(v):
    return v.scored


@query("best_portfolio", "portfolio:s utility:f", "SELECT portfolio, utility FROM scored WHERE feasible OR portfolio = 'P1' ORDER BY utility DESC, portfolio = 'P1' DESC, portfolio DESC LIMIT 1")
def _(v):
    return pf.best_portfolio(v.scored, "P1")


@query("portfolio_walk_forward", "first_month:d last_month:d chosen:s turnover:f4 challenger_net:f4 candidate_net:f4 benchmark_net:f4 versus_candidate:f4 versus_benchmark:f4")
def _(v):
    return pf.portfolio_walk_forward(v.monthly, v.weights, v.market, "P1", ANCHORS, RESERVE)


_SHOCKS = [("crash", "1", -40.0), ("crash", "2", -30.0), ("crash", "5", -35.0), ("rates", "1", -10.0), ("rates", "3", 4.0), ("rates", "9", -12.0), ("boom", "7", 25.0)]


@query("scenario_loss", "portfolio:s scenario:s loss:f covered_weight:f", "SELECT portfolio, scenario, sum(weight*shock/100) AS loss, sum(weight) AS covered_weight FROM weights JOIN (VALUES "
       + ", ".join(f"('{a}','{b}',{c}e0)" for a, b, c in _SHOCKS) + ") s(scenario, symbol, shock) USING (symbol) GROUP BY 1, 2")
def _(v):
    return pf.scenario_loss(v.weights, v.spark.createDataFrame(_SHOCKS, "scenario string, symbol string, shock double"))


@view("positions", """
SELECT 'P' || o_custkey AS portfolio, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS shares, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100e0 AS value,
 CASE any_value(s_nationkey) % 4 WHEN 0 THEN 'Broad market' ELSE 'S' || any_value(s_nationkey) % 6 END AS sector, 'C' || any_value(s_nationkey) AS country, CASE l_suppkey % 9 WHEN 0 THEN 'gold' WHEN 1 THEN 'fund' ELSE 'stock' END AS kind,
 (l_suppkey % 30)/10e0 AS beta FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_custkey, l_suppkey""")
def _positions(v):
    j = (v.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity").join(v.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy("o_custkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("shares"),
                                                (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 100.0).alias("value"))
         .join(v.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    n, s = F.col("s_nationkey"), F.col("l_suppkey")
    return j.select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("portfolio"), s.cast("string").alias("symbol"), "shares", "value",
                    F.when(n % 4 == 0, "Broad market").otherwise(F.concat(F.lit("S"), (n % 6).cast("string"))).alias("sector"), F.concat(F.lit("C"), n.cast("string")).alias("country"),
                    F.when(s % 9 == 0, "gold").when(s % 9 == 1, "fund").otherwise("stock").alias("kind"), ((s % 30) / 10.0).alias("beta"))


def _largest(col, where):
    return f"(SELECT portfolio, arg_max({col}, (v, {col})) AS k, max(v) AS v FROM (SELECT portfolio, {col}, sum(value) AS v FROM positions WHERE {where} GROUP BY 1, 2) GROUP BY 1)"


@query("concentration", "portfolio:s largest_stock:s stock_weight:f largest_sector:s sector_weight:f largest_country:s country_weight:f stress_loss:f status:s", f"""
SELECT *, CASE WHEN coalesce(stock_weight,0) > 20 OR coalesce(sector_weight,0) > 45 THEN 'concentrated' ELSE 'reasonably spread' END AS status FROM (
SELECT t.portfolio, a.k AS largest_stock, a.v/total*100 AS stock_weight, coalesce(b.k, 'Broad market') AS largest_sector, coalesce(b.v, total)/total*100 AS sector_weight, c.k AS largest_country, c.v/total*100 AS country_weight, loss/total*100 AS stress_loss
FROM (SELECT portfolio, sum(value) AS total, sum(value*CASE kind WHEN 'gold' THEN 5 WHEN 'fund' THEN 20 ELSE least(40, greatest(10, coalesce(nullif(beta,0),1)*20)) END/100) AS loss FROM positions GROUP BY 1) t
LEFT JOIN {_largest('symbol', "kind = 'stock'")} a ON a.portfolio = t.portfolio LEFT JOIN {_largest('sector', "sector <> 'Broad market'")} b ON b.portfolio = t.portfolio LEFT JOIN {_largest('country', 'true')} c ON c.portfolio = t.portfolio)""")
def _(v):
    return pf.concentration(v.positions)


@query("portfolio_performance", "portfolio:s start_value:f2 end_value:f2 coverage:f portfolio_return:f benchmark_return:f excess:f", """
SELECT *, pr AS portfolio_return, br AS benchmark_return, pr - br AS excess FROM (SELECT *, (end_value/start_value-1)*100 AS pr FROM (
 SELECT portfolio, sum(CASE WHEN n >= 2 THEN shares*p0 END) AS start_value, sum(CASE WHEN n >= 2 THEN shares*p1 END) AS end_value, avg(CASE WHEN n >= 2 THEN 100e0 ELSE 0e0 END) AS coverage FROM positions p LEFT JOIN (
  SELECT ticker, arg_min(close, session_date) AS p0, arg_max(close, session_date) AS p1, count(*) AS n FROM bars WHERE session_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' GROUP BY 1) e ON e.ticker = p.symbol GROUP BY 1)),
 (SELECT (arg_max(bench_close, session_date)/arg_min(bench_close, session_date)-1)*100 AS br FROM bench WHERE session_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')""")
def _(v):
    return pf.performance(v.positions, v.bars.withColumnRenamed("ticker", "symbol"), F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date"), v.bench)


# --- look-through ----------------------------------------------------------------------------------------------------

_ALIASES = {"ALPHA": (["11", "12"], ["BRAND#11"]), "BETA": (["7"], ["BRAND#22", "BRAND#23"]), "GAMMA": ([], ["BRAND#3"])}


@view("fund_holdings", """
SELECT fund, as_of, ticker, name, v/sum(v) OVER (PARTITION BY fund)*CASE WHEN CAST(fund AS BIGINT) % 5 = 0 THEN 80 ELSE 100 END AS weight,
 CASE WHEN ticker IN ('11','12') OR name LIKE '%BRAND#11%' THEN 'ALPHA' WHEN ticker = '7' OR name LIKE '%BRAND#22%' OR name LIKE '%BRAND#23%' THEN 'BETA' WHEN name LIKE '%BRAND#3%' THEN 'GAMMA' END AS company
FROM (SELECT CAST(s_nationkey AS VARCHAR) AS fund, DATE '2001-06-01' - CAST(s_nationkey*5 AS INTEGER) AS as_of, CAST(l_partkey AS VARCHAR) AS ticker, upper(any_value(p_brand)) AS name, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE) AS v
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_nationkey, l_partkey)""")
def _fund_holdings(v):
    j = (v.table("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").join(v.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
         .groupBy("s_nationkey", "l_partkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("v"))
         .join(v.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")))
    total = j.groupBy("s_nationkey").agg(F.sum("v").alias("total"))
    n = F.col("s_nationkey")
    rows = j.join(total, "s_nationkey").select(n.cast("string").alias("fund"), F.date_sub(F.lit("2001-06-01").cast("date"), (n * 5).cast("int")).alias("as_of"),
                                               F.col("l_partkey").cast("string").alias("ticker"), F.upper("p_brand").alias("name"),
                                               (F.col("v") / F.col("total") * F.when(n % 5 == 0, 80).otherwise(100)).alias("weight"))
    return pf.match_company(rows, _ALIASES)


@query("alias_company_join", "company:s holdings:l weight:f4", "SELECT company, count(*) AS holdings, sum(weight) AS weight FROM fund_holdings WHERE company IS NOT NULL GROUP BY 1")
def _(v):
    return v.fund_holdings.filter("company IS NOT NULL").groupBy("company").agg(F.count(F.lit(1)).alias("holdings"), F.sum("weight").alias("weight"))


_OWN = [("1", 20.0), ("2", 15.0), ("5", 10.0), ("14", 12.0), ("21", 5.0), ("ALPHA", 6.0), ("GAMMA", 3.0), ("DELTA", 1.0)]


@query("lookthrough_exposure", "symbol:s direct:f inside_funds:f effective:f", "WITH own AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {w}e0)" for s, w in _OWN) + """) t(symbol, weight)),
ready AS (SELECT fund FROM fund_holdings GROUP BY fund HAVING DATE '2001-06-10' - max(as_of) BETWEEN 0 AND 75 AND sum(weight) BETWEEN 95 AND 105)
SELECT coalesce(o.symbol, i.symbol) AS symbol, coalesce(o.weight, 0) AS direct, coalesce(i.x, 0) AS inside_funds, coalesce(o.weight, 0) + coalesce(i.x, 0) AS effective FROM own o FULL OUTER JOIN (
 SELECT company AS symbol, sum(w.weight*h.weight/100) AS x FROM fund_holdings h JOIN own w ON w.symbol = h.fund WHERE company IS NOT NULL AND fund IN (SELECT fund FROM ready) GROUP BY 1) i ON i.symbol = o.symbol""")
def _(v):
    own = v.spark.createDataFrame(_OWN, "symbol string, weight double")
    return pf.lookthrough(own, v.fund_holdings, F.lit("2001-06-10").cast("date"))
