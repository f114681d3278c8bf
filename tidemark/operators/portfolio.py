"""Portfolio analytics: period returns, co-movement, path risk, look-through and candidate scoring.

Co-movement of any number of assets is added up in blocks. The assets of a portfolio study are a short list, which is
checked (``MAX_ASSETS``), and their n-by-n matrix is one small value; portfolios, which can be many, stay rows and are
evaluated by array expressions without multiplying rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import rolling_product, running_wealth
from tidemark.operators.sets import global_position
from tidemark.session import reliable_checkpoint

#: Assets of one portfolio study, whose matrix travels with the portfolios; co-movement itself has no such bound.
MAX_ASSETS = 2000
#: Assets in a block of the co-movement sums, and tasks that share the dates of a pair of blocks.
SIDE, SLICES = 64, 4
#: Portfolios in a slice, which meets the matrix once.
SLICE = 256


def month_end_returns(prices: DataFrame, key="symbol", ts="session_date", price="close") -> DataFrame:
    """Last close of each month against the previous available month."""
    monthly = (prices.filter(F.col(price) > 0).groupBy(key, F.trunc(ts, "MM").alias("month"))
               .agg(F.max_by(price, ts).alias("month_close")))
    w = Window.partitionBy(key).orderBy("month")
    return (monthly.withColumn("ret", F.col("month_close") / F.lag("month_close").over(w) - 1).filter("ret IS NOT NULL"))


def point_in_time_month_returns(prices: DataFrame, cutoff: Column, key="symbol", ts="session_date", available="available_at") -> DataFrame:
    """Month returns from prices that were observed and available by the cutoff."""
    return month_end_returns(prices.filter((F.col(ts) <= cutoff) & (F.col(available) <= cutoff)), key, ts)


def asset_list(df: DataFrame, key: str) -> list[str]:
    names = [r[0] for r in df.select(key).distinct().orderBy(key).limit(MAX_ASSETS + 1).collect()]
    if len(names) > MAX_ASSETS:
        raise ValueError(f"more than {MAX_ASSETS} assets in one co-movement study")
    return names


def gram(returns: DataFrame, key="symbol", ts="month", value="ret") -> DataFrame:
    """Sums behind every pairwise moment: count, sums, squares and cross product over the dates both assets have.

    Assets are numbered and cut into blocks of ``SIDE``. For each date a block is one short vector, every pair of blocks
    meets once, and a task adds up the outer products of its dates, so pairs are written once per task and not per date,
    and no table of all assets exists anywhere. Values are taken from their asset's mean, which leaves every moment about
    the mean as it is and keeps its digits.
    """
    known = returns.filter(F.col(value).isNotNull())
    means = global_position(known.groupBy(key).agg(F.avg(value).alias("_c")), [key], "_i")
    numbered = means.select(key, "_c", F.floor(F.col("_i") / SIDE).cast("int").alias("b"), (F.col("_i") % SIDE).cast("int").alias("s"), F.col("_i").cast("long").alias("_i"))
    cells = known.join(numbered, key).groupBy(ts, "b").agg(F.collect_list(F.struct("s", (F.col(value) - F.col("_c")).alias("v"))).alias("a"))
    right = cells.select(ts, F.col("b").alias("c"), F.col("a").alias("z"))
    meet = cells.join(right, ts).where("b <= c").select("b", "c", F.pmod(F.xxhash64(ts), F.lit(SLICES)).alias("k"), "a", "z")

    def blocks(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for pair, rows in batch.groupby(["b", "c"]):
                sums = total.setdefault(pair, np.zeros((6, SIDE, SIDE)))
                (x, m), (y, k) = _matrix(rows["a"]), _matrix(rows["z"])
                sums += np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y])
        for (b, c), sums in total.items():
            i, j = np.nonzero(sums[0])
            if b == c:
                i, j = i[i <= j], j[i <= j]
            yield pd.DataFrame({"l": b * SIDE + i, "r": c * SIDE + j, **{n: sums[q, i, j] for q, n in enumerate(("n", "sl", "sr", "sll", "srr", "slr"))}})

    sums = ("n", "sl", "sr", "sll", "srr", "slr")
    part = meet.repartition("b", "c", "k").mapInPandas(blocks, "l long, r long, n double, sl double, sr double, sll double, srr double, slr double")
    upper = part.groupBy("l", "r").agg(*[F.sum(c).alias(c) for c in sums])
    lower = upper.filter("l <> r").select(F.col("r").alias("l"), F.col("l").alias("r"), "n", F.col("sr").alias("sl"), F.col("sl").alias("sr"), F.col("srr").alias("sll"), F.col("sll").alias("srr"), "slr")
    names = numbered.select("_i", F.col(key).cast("string").alias("_k"))
    out = upper.unionByName(lower).join(names.select(F.col("_i").alias("l"), F.col("_k").alias("left")), "l")
    return out.join(names.select(F.col("_i").alias("r"), F.col("_k").alias("right")), "r").select("left", "right", *sums)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block, one row per date, and which are there."""
    x, m = np.zeros((len(column), SIDE)), np.zeros((len(column), SIDE))
    for i, cells in enumerate(column):
        at = [c["s"] for c in cells]
        x[i, at], m[i, at] = [c["v"] for c in cells], 1.0
    return x, m


def _cov() -> Column:
    return (F.col("slr") - F.col("sl") * F.col("sr") / F.col("n")) / (F.col("n") - 1)


def pairwise_stats(returns: DataFrame, key="symbol", ts="session_date", value="ret", minimum: int = 40, periods: int = 252) -> DataFrame:
    """Correlation and annual covariance of every pair over common dates; NULL below ``minimum`` of them."""
    g = gram(returns, key, ts, value)
    vl = (F.col("sll") - F.col("sl") * F.col("sl") / F.col("n"))
    vr = (F.col("srr") - F.col("sr") * F.col("sr") / F.col("n"))
    raw = (F.col("slr") - F.col("sl") * F.col("sr") / F.col("n")) / F.nullif(F.sqrt(vl * vr), F.lit(0.0))
    ok = F.col("n") >= minimum
    return g.select("left", "right", F.col("n").cast("bigint").alias("observations"),
                    F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).alias("correlation"), F.when(ok, _cov() * periods).alias("covariance"))


def covariance(returns: DataFrame, shrink: float = 0.5, key="symbol", ts="month", value="ret") -> DataFrame:
    """Sample covariance with cross terms shrunk towards zero; variances keep their size."""
    c = _cov()
    return gram(returns, key, ts, value).filter("n >= 2").select(
        "left", "right", F.when(F.col("left") == F.col("right"), c).otherwise(c * (1 - shrink)).alias("cov"))


def strongest_pair(stats: DataFrame) -> DataFrame:
    pairs = stats.filter((F.col("left") < F.col("right")) & F.col("correlation").isNotNull())
    best = pairs.agg(F.max(F.struct(F.col("correlation"), F.col("left"), F.col("right"))).alias("b"))
    return best.select("b.left", "b.right", "b.correlation")


def robust_means(returns: DataFrame, anchors: list[str], reserve: list[str], key="symbol", value="ret", periods: int = 12) -> DataFrame:
    """Annual means pulled 90% towards the median of the anchor assets; reserve assets keep their own mean."""
    own = returns.groupBy(key).agg((F.avg(value) * periods).alias("own"))
    centre = own.filter(F.col(key).isin(anchors)).agg(F.coalesce(F.median("own"), F.lit(0.06))).scalar()
    own = own.withColumn("_c", centre)
    return own.select(key, F.when(F.col(key).isin(reserve), F.col("own")).otherwise(0.9 * F.col("_c") + 0.1 * F.col("own")).alias("mu"))


def path_metrics(returns: DataFrame, key="symbol", ts="month", value="ret", per_year: int = 12, window: int = 24, tail: float = 0.05) -> DataFrame:
    """Annual return, volatility, drawdown from a start of 1, best and worst rolling window, mean of the worst tail."""
    r = returns.withColumn("ret", F.col(value))
    r = rolling_product(running_wealth(r, "ret", key, ts), window, "ret", key, ts, "_roll")
    worst = Window.partitionBy(key).orderBy("ret", ts)
    r = r.withColumn("_rank", F.row_number().over(worst)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    in_tail = F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * tail))
    n = F.count(F.lit(1))
    final = F.max_by("wealth", ts)
    return r.groupBy(key).agg(
        n.alias("periods"), F.when(final > 0, F.pow(final, F.lit(float(per_year)) / n) - 1).otherwise(-1.0).alias("annual_return"),
        (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(per_year)).alias("annual_volatility"),
        F.least(F.lit(0.0), F.min("running_drawdown")).alias("max_drawdown"), F.min("_roll").alias("worst_window"), F.max("_roll").alias("best_window"),
        F.avg(F.when(in_tail, F.col("ret"))).alias("cvar95"))


def information_ratio(pairs: DataFrame, left: str, right: str, key: list[str] | None = None, per_year: int = 12) -> DataFrame:
    d = F.col(left) - F.col(right)
    te = F.stddev_samp(d)
    return pairs.groupBy(*(key or [])).agg(F.when((F.count(d) >= 2) & (te > 1e-12), F.avg(d) / te * math.sqrt(per_year)).alias("information_ratio"))


def beta(returns: DataFrame, market: DataFrame, key="symbol", ts="month", longest: int = 60, shortest: int = 36) -> DataFrame:
    """Slope on the market over the last common months, and the clamped value used for discount rates."""
    j = returns.join(market.select(ts, F.col("ret").alias("market_ret")), ts)
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    j = j.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= longest)
    out = j.groupBy(key).agg(F.count(F.lit(1)).alias("months"), F.regr_slope("ret", "market_ret").alias("raw"))
    ready = (F.col("months") >= shortest) & F.col("raw").isNotNull()
    return (out.withColumn("ready", ready).withColumn("raw_beta", F.when(ready, F.col("raw")))
            .withColumn("used_beta", F.when(ready, F.least(F.lit(1.6), F.greatest(F.lit(0.8), F.col("raw"))))).drop("raw"))


# --- many portfolios over a short asset list -------------------------------------------------------------------------

def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def _known(row: Column) -> Column:
    return F.transform(row, lambda x: F.coalesce(x, F.lit(0.0)))


def weight_vectors(weights: DataFrame, assets: list[str], portfolio="portfolio", key="symbol", value="weight") -> DataFrame:
    """One row per portfolio with its weights in asset order; a portfolio has at most one entry per listed asset."""
    w = weights.filter(F.col(key).isin(assets)).groupBy(portfolio, key).agg(F.sum(value).alias("w"))
    m = w.groupBy(portfolio).agg(F.map_from_entries(F.collect_list(F.struct(key, "w"))).alias("_m"))
    order = F.array(*[F.lit(a) for a in assets])
    return m.select(portfolio, F.transform(order, lambda a: F.coalesce(F.try_element_at("_m", a), F.lit(0.0))).alias("w"))


def matrix_value(cov: DataFrame, assets: list[str], left="left", right="right", value="cov") -> Column:
    """The table as one array-of-arrays scalar with a row and a column for each listed asset, in their order. Cells are found
    by name; a pair that is not in the table is NULL."""
    rows = cov.groupBy(left).agg(F.map_from_entries(F.collect_list(F.struct(right, value))).alias("a"))
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct(left, "a"))).alias("m"))
    names = F.array(*[F.lit(str(a)) for a in assets])
    return whole.select(F.transform(names, lambda x: F.transform(names, lambda y: F.try_element_at(F.try_element_at("m", x), y)))).scalar()


def vector_value(df: DataFrame, key: str, value: str) -> Column:
    return df.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias("m")).select("m.v").scalar()


def portfolio_returns(weights: DataFrame, returns: DataFrame, portfolio="portfolio", key="symbol", ts="month") -> DataFrame:
    """Period returns of every portfolio over the periods all assets share. The return matrix travels as one value."""
    from tidemark.operators.sets import common_months
    assets = asset_list(returns, key)
    shared = returns.join(common_months(returns, key, ts), ts, "left_semi")
    rows = shared.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(key, "ret"))).alias("a"))
    matrix = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("a.ret").alias("r"))))).scalar()
    vec = weight_vectors(weights, assets, portfolio, key).withColumn("_m", matrix)
    each = F.transform("_m", lambda row: F.struct(row["t"].alias("t"), (_dot(F.col("w"), row["r"]) / 100.0).alias("r")))
    return vec.select(portfolio, F.explode(each).alias("x")).select(portfolio, F.col("x.t").alias(ts), F.col("x.r").alias("ret"))


def portfolio_variance(weights: DataFrame, cov: DataFrame, assets: list[str], portfolio="portfolio") -> DataFrame:
    """Weights as fractions, their covariance products and the portfolio variance; one row per portfolio. Pairs without a
    covariance add nothing."""
    vec = weight_vectors(weights, assets, portfolio).withColumn("_c", matrix_value(cov, assets))
    vec = vec.withColumn("w", F.transform("w", lambda x: x / 100.0))
    vec = vec.withColumn("cw", F.transform("_c", lambda row: _dot(F.col("w"), _known(row))))
    return vec.withColumn("variance", _dot(F.col("w"), F.col("cw"))).drop("_c")


def risk_contributions(weights: DataFrame, cov: DataFrame, assets: list[str], portfolio="portfolio") -> DataFrame:
    """Share of the portfolio variance each held asset carries, in percent."""
    v = portfolio_variance(weights, cov, assets, portfolio).filter("variance > 0")
    names = F.array(*[F.lit(a) for a in assets])
    rows = F.explode(F.arrays_zip(names.alias("symbol"), F.col("w"), F.col("cw")))
    return (v.select(portfolio, "variance", rows.alias("x")).select(portfolio, "variance", F.col("x.symbol").alias("symbol"), F.col("x.w").alias("w"), F.col("x.cw").alias("cw"))
            .filter("w > 0").withColumn("risk_contribution", F.col("w") * F.col("cw") / F.col("variance") * 100).drop("cw"))


def average_correlation(weights: DataFrame, stats: DataFrame, assets: list[str], portfolio="portfolio") -> DataFrame:
    """Weight-averaged correlation of each held asset with the other holdings whose correlation is known."""
    vec = weight_vectors(weights, assets, portfolio).withColumn("_c", matrix_value(stats.select("left", "right", F.col("correlation").alias("cov")), assets))
    at = F.sequence(F.lit(0), F.lit(len(assets) - 1))
    names = F.array(*[F.lit(a) for a in assets])

    def peers(i, known):
        row = F.get(F.col("_c"), i)
        return _total(F.transform(at, lambda j: F.when((j != i) & F.get(row, j).isNotNull(),
                                                       F.get(F.col("w"), j) * (F.lit(1.0) if known else F.get(row, j))).otherwise(0.0)))
    rows = F.transform(at, lambda i: F.struct(F.get(names, i).alias("symbol"), F.get(F.col("w"), i).alias("w"), peers(i, False).alias("num"), peers(i, True).alias("den")))
    return (vec.select(portfolio, F.explode(rows).alias("x")).select(portfolio, "x.*").filter("w > 0")
            .withColumn("average_correlation", F.when(F.col("den") > 0, F.col("num") / F.col("den"))).drop("num", "den"))


def score_portfolios(candidates: DataFrame, mu: DataFrame, cov: DataFrame, bounds: DataFrame | None = None, group_caps: dict[str, tuple[float, float]] | None = None,
                     overlap: DataFrame | None = None, lookthrough_cap: float = 8.0, aversion: float = 0.625, portfolio="portfolio") -> DataFrame:
    """Utility of every candidate and whether it respects asset bounds, group totals and the look-through cap.

    ``bounds`` has (symbol, low, high, group); ``overlap`` is a full (left fund, right company, cov) square of the share,
    in percent, of the company inside the fund.
    """
    assets = asset_list(mu, "symbol")
    return score_vectors(reliable_checkpoint(weight_vectors(candidates, assets, portfolio)), assets, mu, cov, bounds, group_caps, overlap, lookthrough_cap, aversion, portfolio)


def _slice_variances(rows: pd.Series, cov: pd.Series) -> pd.Series:
    """Variances of the portfolios of each slice, by one product of their weights with the matrix."""
    out = []
    for weights, table in zip(rows, cov):
        w = np.stack(weights) / 100.0
        out.append(((w @ np.stack(table).T) * w).sum(axis=1))
    return pd.Series(out)


def score_vectors(vectors: DataFrame, assets: list[str], mu: DataFrame, cov: DataFrame, bounds: DataFrame | None = None, group_caps: dict[str, tuple[float, float]] | None = None,
                  overlap: DataFrame | None = None, lookthrough_cap: float = 8.0, aversion: float = 0.625, portfolio="portfolio") -> DataFrame:
    """``score_portfolios`` of portfolios that are one row with weights in the order of ``assets`` already. They are stored rows, since
    they are counted first: portfolios meet in slices of about ``SLICE``, and the matrix is sent once per slice."""
    slices = F.lit(max(1, -(-vectors.count() // SLICE)))
    v = vectors.groupBy(F.pmod(F.xxhash64(portfolio), slices)).agg(F.collect_list(F.struct(portfolio, "w")).alias("_p")).withColumn("_c", matrix_value(cov, assets))
    v = v.withColumn("_v", F.pandas_udf(_slice_variances, "array<double>")("_p.w", F.transform("_c", _known))).select(F.explode(F.arrays_zip("_p", "_v")).alias("x"))
    v = v.select(f"x._p.{portfolio}", F.transform("x._p.w", lambda x: x / 100.0).alias("w"), F.col("x._v").alias("variance")).withColumn("_mu", vector_value(mu, "symbol", "mu"))
    v = v.withColumn("expected", _dot(F.col("w"), F.col("_mu"))).withColumn("utility", F.col("expected") - aversion * F.greatest(F.lit(0.0), F.col("variance")))
    v = v.withColumn("feasible", F.lit(True))
    if bounds is not None:
        lows, highs = vector_value(bounds, "symbol", "low"), vector_value(bounds, "symbol", "high")
        v = v.withColumn("_lo", lows).withColumn("_hi", highs)
        inside = F.forall(F.arrays_zip(F.col("w"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")),
                          lambda x: (x["w"] * 100 >= x["lo"] - 1e-9) & (x["w"] * 100 <= x["hi"] + 1e-9))
        v = v.withColumn("feasible", F.col("feasible") & inside).drop("_lo", "_hi")
    if group_caps:
        v = v.withColumn("_g", vector_value(bounds, "symbol", "group"))
        for name, (low, high) in group_caps.items():
            part = _total(F.zip_with("w", "_g", lambda w, g: F.when(g == name, w * 100).otherwise(0.0)))
            v = v.withColumn("feasible", F.col("feasible") & part.between(low - 1e-9, high + 1e-9))
        v = v.drop("_g")
    if overlap is not None:
        v = v.withColumn("_o", matrix_value(overlap.select(F.col("right").alias("left"), F.col("left").alias("right"), "cov"), assets))
        effective = F.zip_with("w", "_o", lambda w, col: w * 100 + _dot(F.col("w"), _known(col)))
        v = v.withColumn("max_exposure", F.array_max(effective)).withColumn("feasible", F.col("feasible") & (F.col("max_exposure") <= lookthrough_cap)).drop("_o")
    return v.drop("w", "_mu")


def best_portfolio(scored: DataFrame, incumbent: str, portfolio="portfolio") -> DataFrame:
    """The feasible candidate of highest utility, or the incumbent when none beats it."""
    ok = scored.filter(F.col("feasible") | (F.col(portfolio) == incumbent))
    b = ok.agg(F.max(F.struct(F.col("utility"), (F.col(portfolio) == incumbent).alias("held"), F.col(portfolio).alias("p"))).alias("b"))
    return b.select(F.col("b.p").alias(portfolio), F.col("b.utility").alias("utility"))


# --- exposure --------------------------------------------------------------------------------------------------------

def match_company(holdings: DataFrame, aliases: dict[str, tuple[list[str], list[str]]], ticker="ticker", name="name", out="company") -> DataFrame:
    """First company of the alias list whose tickers hold the ticker or one of whose names occurs in the holding's name."""
    t, n = F.upper(F.coalesce(F.col(ticker), F.lit(""))), F.upper(F.coalesce(F.col(name), F.lit("")))
    chain = None
    for company, (tickers, names) in aliases.items():
        hit = t.isin(tickers) if tickers else F.lit(False)
        for alias in names:
            hit = hit | n.contains(alias)
        chain = F.when(hit, F.lit(company)) if chain is None else chain.when(hit, F.lit(company))
    return holdings.withColumn(out, chain)


def fund_readiness(holdings: DataFrame, as_of: Column, max_age: int = 75, fund="fund") -> DataFrame:
    """A fund report is usable when fresh and when its weights add up to about 100."""
    r = holdings.groupBy(fund).agg(F.max("as_of").alias("as_of"), F.count(F.lit(1)).alias("positions"), F.sum("weight").alias("total_weight"))
    age = F.datediff(as_of, "as_of")
    return r.withColumn("ready", age.between(0, max_age) & F.col("total_weight").between(95, 105))


def lookthrough(weights: DataFrame, holdings: DataFrame, as_of: Column, max_age: int = 75) -> DataFrame:
    """Direct plus hidden exposure to every company, through usable funds only. ``weights`` lists funds and companies."""
    ready = fund_readiness(holdings, as_of, max_age).filter("ready").select("fund")
    fund_weight = weights.select(F.col("symbol").alias("fund"), F.col("weight").alias("fund_weight"))
    inside = (holdings.filter(F.col("company").isNotNull()).groupBy("fund", "company").agg(F.sum("weight").alias("weight"))
              .join(ready, "fund", "left_semi").join(fund_weight, "fund").groupBy(F.col("company").alias("symbol"))
              .agg(F.sum(F.col("fund_weight") * F.col("weight") / 100).alias("inside_funds")))
    direct = weights.select("symbol", F.col("weight").alias("direct"))
    out = direct.join(inside, "symbol", "full_outer").fillna(0.0, ["direct", "inside_funds"])
    return out.withColumn("effective", F.col("direct") + F.col("inside_funds"))


def concentration(positions: DataFrame, portfolio="portfolio") -> DataFrame:
    """Largest single stock, sector and country, and the loss in a market fall, per portfolio."""
    p = positions.filter("value > 0")
    fall = F.when(F.col("kind") == "gold", 5.0).when(F.col("kind") == "fund", 20.0).otherwise(
        F.least(F.lit(40.0), F.greatest(F.lit(10.0), F.coalesce(F.nullif(F.col("beta"), F.lit(0.0)), F.lit(1.0)) * 20)))
    total = p.groupBy(portfolio).agg(F.sum("value").alias("total"), F.sum(F.col("value") * fall / 100).alias("_loss"))
    def largest(rows, col, name):
        s = rows.groupBy(portfolio, col).agg(F.sum("value").alias("v"))
        return s.groupBy(portfolio).agg(F.max(F.struct("v", col)).alias(name))
    stock = largest(p.filter("kind = 'stock'"), "symbol", "_st")
    sector = largest(p.filter("sector <> 'Broad market'"), "sector", "_se").unionByName(
        largest(p, "sector", "_se").join(p.filter("sector <> 'Broad market'").select(portfolio).distinct(), portfolio, "left_anti"))
    country = largest(p, "country", "_co")
    out = total.join(stock, portfolio, "left").join(sector, portfolio, "left").join(country, portfolio, "left")
    share = lambda c: F.col(f"{c}.v") / F.col("total") * 100
    out = out.select(portfolio, "total", F.col("_st.symbol").alias("largest_stock"), share("_st").alias("stock_weight"), F.col("_se.sector").alias("largest_sector"),
                     share("_se").alias("sector_weight"), F.col("_co.country").alias("largest_country"), share("_co").alias("country_weight"),
                     (F.col("_loss") / F.col("total") * 100).alias("stress_loss"))
    watch = (F.coalesce("stock_weight", F.lit(0.0)) > 20) | (F.coalesce("sector_weight", F.lit(0.0)) > 45)
    return out.withColumn("status", F.when(watch, "concentrated").otherwise("reasonably spread"))


def scenario_loss(weights: DataFrame, shocks: DataFrame, portfolio="portfolio") -> DataFrame:
    """Weighted shock per scenario; an asset without a shock contributes nothing and lowers the covered weight."""
    j = weights.join(shocks, "symbol")
    return j.groupBy(portfolio, "scenario").agg(F.sum(F.col("weight") * F.col("shock") / 100).alias("loss"), F.sum("weight").alias("covered_weight"))


def performance(positions: DataFrame, prices: DataFrame, start: Column, end: Column, bench: DataFrame, portfolio="portfolio") -> DataFrame:
    """Value at both ends of a range, return against the benchmark and the share of value that has prices."""
    span = prices.filter(F.col("session_date").between(start, end))
    ends = span.groupBy("symbol").agg(F.min_by("close", "session_date").alias("p0"), F.max_by("close", "session_date").alias("p1"), F.count(F.lit(1)).alias("_n"))
    b = bench.filter(F.col("session_date").between(start, end)).agg(
        (F.max_by("bench_close", "session_date") / F.min_by("bench_close", "session_date") - 1).alias("b")).scalar()
    j = positions.join(ends, "symbol", "left").withColumn("_ok", F.coalesce(F.col("_n") >= 2, F.lit(False)))
    out = j.groupBy(portfolio).agg(
        F.sum(F.when(F.col("_ok"), F.col("shares") * F.col("p0"))).alias("start_value"), F.sum(F.when(F.col("_ok"), F.col("shares") * F.col("p1"))).alias("end_value"),
        (F.count_if("_ok") / F.count(F.lit(1)) * 100).alias("coverage"))
    out = out.withColumn("portfolio_return", (F.col("end_value") / F.col("start_value") - 1) * 100).withColumn("benchmark_return", b * 100)
    return out.withColumn("excess", F.col("portfolio_return") - F.col("benchmark_return"))


# --- walk-forward ----------------------------------------------------------------------------------------------------

def portfolio_walk_forward(returns: DataFrame, candidates: DataFrame, market: DataFrame, incumbent: str, anchors: list[str], reserve: list[str],
                           train_months: int = 36, test_months: int = 12, cost_bps: float = 20.0) -> DataFrame:
    """Yearly, non-overlapping test windows after an expanding training period; costs are charged on turnover.

    The driver walks over the windows (one per year of history); fitting, scoring and measuring each are Spark jobs. Returns and weights
    are computed once before. Training months are those of all assets, so one order of assets holds for every window.
    """
    from tidemark.operators.sets import common_months
    spark = returns.sparkSession
    returns, market = reliable_checkpoint(returns.select("symbol", "month", "ret")), reliable_checkpoint(market.select("month", "ret"))
    candidates = reliable_checkpoint(candidates.groupBy("portfolio", "symbol").agg(F.sum("weight").alias("weight")))
    months = [r[0] for r in common_months(returns).join(market.select("month"), "month", "left_semi").orderBy("month").collect()]
    assets = asset_list(returns, "symbol")
    vectors = reliable_checkpoint(weight_vectors(candidates, assets))
    cost, rows = cost_bps / 10_000, []
    for at in range(train_months, len(months) - test_months + 1, test_months):
        train = returns.filter(F.col("month").isin(months[:at]))
        window = months[at:at + test_months]
        scored = score_vectors(vectors, assets, robust_means(train, anchors, reserve), covariance(train))
        chosen = best_portfolio(scored, incumbent).first()["portfolio"]
        pair = candidates.filter(F.col("portfolio").isin([chosen, incumbent]))
        test = portfolio_returns(pair, returns.filter(F.col("month").isin(window)))
        got = {(r["portfolio"], r["month"]): r["ret"] for r in test.collect()}
        bench = {r["month"]: r["ret"] for r in market.filter(F.col("month").isin(window)).select("month", "ret").collect()}
        gap = pair.groupBy("symbol").agg(F.sum(F.when(F.col("portfolio") == chosen, F.col("weight")).otherwise(0.0)).alias("a"),
                                         F.sum(F.when(F.col("portfolio") == incumbent, F.col("weight")).otherwise(0.0)).alias("b"))
        turnover = (gap.agg(F.sum(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0) / 200

        def net(values, charge):
            return (float(np.prod([1 + x for x in values])) * (1 - charge) - 1) * 100
        rows.append((window[0], window[-1], chosen, turnover * 100, net([got[(chosen, m)] for m in window], turnover * cost),
                     net([got[(incumbent, m)] for m in window], 0.0), net([bench[m] for m in window], cost)))
    schema = "first_month date, last_month date, chosen string, turnover double, challenger_net double, candidate_net double, benchmark_net double"
    out = spark.createDataFrame(rows, schema)
    return out.withColumn("versus_candidate", F.col("challenger_net") - F.col("candidate_net")).withColumn("versus_benchmark", F.col("challenger_net") - F.col("benchmark_net"))


def walk_forward_verdict(windows: DataFrame, minimum: int = 5, samples: int = 2000) -> DataFrame:
    """Wins, window-bootstrap intervals and the evidence gate."""
    from tidemark.operators.scores import cluster_bootstrap
    one = F.lit(1).alias("_j")
    out = windows.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("versus_candidate") > 0).alias("candidate_wins"),
                      F.count_if(F.col("versus_benchmark") > 0).alias("benchmark_wins"), one)
    for name, seed in (("candidate", 20260809), ("benchmark", 20260810)):
        ci = cluster_bootstrap(windows, "first_month", F.col(f"versus_{name}"), F.lit(1), samples, seed)
        out = out.join(ci.select(F.col("lower95").alias(f"{name}_low"), F.col("upper95").alias(f"{name}_high"), one), "_j", "left")
    need = F.ceil(F.col("windows") * 0.8)
    strong = ((F.col("windows") >= minimum) & (F.col("candidate_wins") >= need) & (F.col("benchmark_wins") >= need)
              & (F.col("candidate_low") > 0) & (F.col("benchmark_low") > 0))
    return out.drop("_j").withColumn("status", F.when(F.coalesce(strong, F.lit(False)), "passed").otherwise("insufficient evidence"))
