"""Cross-sectional scores over a table of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import band, clamp, step_score, weighted_available
from tidemark.operators.sets import global_position


def zscores(df: DataFrame, values: dict[str, Column], sector: str | None = None, minimum: int = 4) -> DataFrame:
    """Population z-scores clamped to +-3 for several values at once; NULL stays NULL and no spread gives 0.

    With ``sector`` a group of at least ``minimum`` known values uses its own mean and spread. All means come from one
    aggregation (two with sectors); rows are never sent through a global window.
    """
    d = df
    for n, c in values.items():
        d = d.withColumn(f"_x_{n}", c)
    aggs = [f for n in values for f in (F.avg(f"_x_{n}").alias(f"m_{n}"), F.stddev_pop(f"_x_{n}").alias(f"s_{n}"), F.count(f"_x_{n}").alias(f"n_{n}"))]
    whole = d.agg(*aggs)
    d = d.withColumn("_all", whole.select(F.struct(*whole.columns)).scalar())
    if sector:
        per = d.groupBy(sector).agg(*aggs)
        d = d.join(per.select(sector, F.struct(*[c for c in per.columns if c != sector]).alias("_sec")), sector, "left")
    for n in values:
        own = F.col(f"_sec.n_{n}") >= minimum if sector else F.lit(False)
        mean = F.when(own, F.col(f"_sec.m_{n}")).otherwise(F.col(f"_all.m_{n}")) if sector else F.col(f"_all.m_{n}")
        sd = F.when(own, F.col(f"_sec.s_{n}")).otherwise(F.col(f"_all.s_{n}")) if sector else F.col(f"_all.s_{n}")
        x = F.col(f"_x_{n}")
        d = d.withColumn(n, F.when(x.isNotNull(), clamp(F.when(sd > 0, (x - mean) / sd).otherwise(0.0), -3.0, 3.0)))
    return d.drop("_all", "_sec", *[f"_x_{n}" for n in values])


def percentile_scores(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """position / (n - 1) * 100 by value, ties broken by the key; a single value scores 50."""
    known = global_position(df.filter(F.col(value).isNotNull()).select(value, key), [value, key], "_pos")
    n = known.agg(F.count(F.lit(1))).scalar()
    scored = known.withColumn("_n", n).select(key, F.when(F.col("_n") == 1, 50.0).otherwise(F.col("_pos") / (F.col("_n") - 1) * 100).alias(name))
    return df.join(scored, key, "left")


def _mean(*cols: str) -> Column:
    return weighted_available([(F.col(c), 1.0) for c in cols])


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def research_label(score) -> Column:
    return band(score, ((35, "Weak"), (55, "Mixed"), (70, "Positive"), (85, "Strong")), "Top tier", "Not ranked")


def research_league(m: DataFrame, key: str = "symbol") -> DataFrame:
    """Value, quality and momentum-with-sentiment factors, their blend as a percentile, and a capped conviction overlay."""
    c = F.col

    def inverse(x):
        return F.when(c(x) > 0, 1 / c(x))
    vol = F.when(c("return_volatility") > 0, c("return_volatility"))
    d = zscores(m, {"z_book": inverse("price_to_book"), "z_earn": inverse("forward_pe"), "z_roe": c("roe"), "z_margin": c("margin"), "z_debt": c("debt_to_equity"),
                    "z_half": c("six_month_return") / vol, "z_year": c("year_return") / vol, "z_breadth": F.when(c("analyst_count") >= 3, c("analyst_positive")),
                    "z_change": c("analyst_change"), "z_revision": F.when(c("revision") == "up", 1.0).when(c("revision") == "down", -1.0), "z_surprise": c("surprise")})
    d = d.withColumn("_value", weighted_available([(c("z_book"), 0.33), (c("z_earn"), 0.67)]))
    d = d.withColumn("_quality", weighted_available([(_mean("z_roe", "z_margin"), 0.25), (c("z_debt"), -0.125)]))
    d = d.withColumn("_price", _mean("z_half", "z_year")).withColumn("_sentiment", _mean("z_breadth", "z_change", "z_revision", "z_surprise"))
    d = zscores(d, {"value_factor": c("_value"), "quality_factor": c("_quality")}, "sector")
    d = zscores(d, {"price_momentum": c("_price"), "sentiment": c("_sentiment")})
    d = zscores(d.withColumn("_mom", _mean("price_momentum", "sentiment")), {"momentum_factor": c("_mom")})
    zero = F.lit(0.0)
    d = d.withColumn("alpha", F.coalesce("momentum_factor", zero) * 0.3334 + F.coalesce("value_factor", zero) * 0.3333 + F.coalesce("quality_factor", zero) * 0.3333)
    d = percentile_scores(d, "alpha", key, "_score")
    ideas = global_position(d.filter(c("owners").isNotNull()).select((-c("active_buyers")).alias("_a"), (-c("owners")).alias("_b"), (-c("conviction")).alias("_c"), key),
                            ["_a", "_b", "_c", key], "_idea")
    n = ideas.agg(F.count(F.lit(1))).scalar()
    ideas = ideas.withColumn("_n", n).select(key, F.when(c("_n") == 1, 75).otherwise(_half_up(55 + (c("_n") - c("_idea") - 1) / (c("_n") - 1) * 45)).alias("investor_conviction"))
    d = d.join(ideas, key, "left")
    overlay = F.coalesce((c("investor_conviction") - 50) * 0.1, zero)
    return (d.withColumn("score", _half_up(c("_score"))).withColumn("label", research_label(c("_score")))
            .withColumn("decision_score", _half_up(clamp(c("_score") + overlay, 0.0, 100.0))))


# --- single-company assessment ---------------------------------------------------------------------------------------

# Multiples per sector regarded as cheap and as fair.
VALUATION_BANDS = {
    "Semiconductors": (18, 32),
    "Software": (22, 38),
    "Technology": (20, 34),
    "Financial services": (11, 20),
    "Healthcare": (18, 30),
    "Consumer": (20, 32),
    "Industrial": (16, 26),
    "Utilities": (14, 23),
    "Energy": (8, 15),
}
DEFAULT_BANDS = (15, 25)
LOW = float("-inf")
ROE = [(30, 100), (20, 85), (15, 72), (8, 55), (0, 35)]
MARGIN = [(25, 100), (15, 85), (8, 68), (3, 52), (0, 35)]
REVENUE = [(20, 100), (10, 82), (5, 68), (0, 52), (-10, 30)]
EARNINGS = [(25, 100), (10, 82), (3, 65), (0, 52), (-15, 28)]
YEAR_RETURN = [(30, 92), (15, 80), (5, 68), (0, 58), (-15, 40)]
YEAR_POSITION = [(80, 82), (55, 72), (35, 58), (15, 40)]


def sector_of(industry) -> Column:
    """Sector of an industry text; the first matching pattern wins."""
    t = F.lower(F.coalesce(F.col(industry) if isinstance(industry, str) else industry, F.lit("")))
    rules = [("semiconductor", "Semiconductors"), ("software|internet|media", "Software"), ("bank|financial|insurance", "Financial services"), ("health|medical|pharma|biotech", "Healthcare"),
             ("energy|oil|gas", "Energy"), ("utilit", "Utilities"), ("industrial|aerospace|machinery|construction", "Industrial"), ("retail|consumer|food|beverage|restaurant", "Consumer"),
             ("technology|electronic", "Technology")]
    out = F.when(t.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("default")


def multiple_score(v: Column, cheap: Column, fair: Column) -> Column:
    return (F.when(v.isNull() | (v <= 0), F.lit(None).cast("double")).when(v <= cheap * 0.8, 95.0).when(v <= cheap, 86.0).when(v <= (cheap + fair) / 2, 72.0)
            .when(v <= fair, 55.0).when(v <= fair * 1.25, 35.0).otherwise(15.0))


def price_to_fair_score(price: Column, fair: Column) -> Column:
    r = price / fair
    return (F.when(price.isNull() | fair.isNull() | (fair <= 0), F.lit(None).cast("double")).when(r <= 0.72, 96.0).when(r <= 0.86, 86.0).when(r <= 1, 72.0).when(r <= 1.15, 52.0)
            .when(r <= 1.35, 30.0).otherwise(12.0))


def _avg(*cs: Column) -> Column:
    return weighted_available([(x, 1.0) for x in cs])


def valuation_view(m: DataFrame) -> DataFrame:
    """Fair value from earnings where there are any, else market multiples alone; never a fair value without earnings."""
    c = F.col
    cheap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in VALUATION_BANDS.items() for x in (k, float(v[0]))]), c("sector")), F.lit(float(DEFAULT_BANDS[0])))
    fair = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in VALUATION_BANDS.items() for x in (k, float(v[1]))]), c("sector")), F.lit(float(DEFAULT_BANDS[1])))
    d = m.withColumn("_cheap", cheap).withColumn("_fair", fair)
    growth = clamp(F.coalesce(F.nullif(_avg(c("revenue_growth"), c("earnings_growth")), F.lit(0.0)), F.lit(8.0)), -10.0, 30.0)
    adjust = clamp(1 + (growth - 8) / 100, 0.82, 1.22)
    d = d.withColumn("_adj", adjust)
    earning = (c("eps") > 0) & (c("price") > 0)
    # The middle of the three sorted values is the fair value, as in a range of low, base and high.
    base = F.get(F.array_sort(F.array(c("eps") * c("_cheap") * 0.9, c("eps") * (c("_cheap") + c("_fair")) / 2 * c("_adj"), c("eps") * c("_fair") * c("_adj"))), F.lit(1))
    d = d.withColumn("fair_value", F.when(earning, base))
    cash_fair = F.when(c("sector") == "Software", 35.0).otherwise(30.0)
    with_eps = _avg(price_to_fair_score(c("price"), c("fair_value")), multiple_score(c("forward_pe"), c("_cheap"), c("_fair")),
                    multiple_score(c("price_to_cash_flow"), F.lit(18.0), cash_fair), multiple_score(c("ev_to_ebitda"), F.lit(12.0), F.lit(24.0)))
    without = _avg(multiple_score(c("forward_pe"), c("_cheap"), c("_fair")), multiple_score(c("price_to_cash_flow"), F.lit(18.0), F.lit(30.0)),
                   multiple_score(c("ev_to_ebitda"), F.lit(12.0), F.lit(24.0)), multiple_score(c("ev_to_revenue"), F.lit(3.0), F.lit(8.0)))
    v = F.when(earning, with_eps).otherwise(without)
    peg = F.when(c("peg") > 0, F.when(c("peg") <= 1, 7).when(c("peg") <= 1.8, 2).when(c("peg") > 3, -7).otherwise(0)).otherwise(0)
    return d.withColumn("valuation", F.when(v.isNotNull(), clamp(v + F.coalesce(peg, F.lit(0)), 0.0, 100.0))).drop("_cheap", "_fair", "_adj")


def assess_company(m: DataFrame) -> DataFrame:
    """Component scores, the 30/25/20/15/10 blend over those available, evidence confidence and the research action."""
    c = F.col
    debt = F.when(c("debt_to_equity").isNull(), F.lit(None).cast("double")).when(c("debt_to_equity") <= 0.35, 95.0).when(c("debt_to_equity") <= 0.8, 75.0).when(c("debt_to_equity") <= 1.5, 50.0).otherwise(20.0)
    d = valuation_view(m).withColumn("quality", _avg(step_score("roe", ROE, 10), step_score("margin", MARGIN, 10), debt))
    d = d.withColumn("analyst", _avg(c("analyst_score"), c("surprise_score")))
    shift = F.when(c("revision") == "up", 7.0).when(c("revision") == "down", -9.0).otherwise(0.0)
    d = d.withColumn("direction", _avg(step_score("revenue_growth", REVENUE, 10), step_score("earnings_growth", EARNINGS, 8),
                                       F.when(c("analyst").isNotNull(), clamp(c("analyst") + F.coalesce(c("analyst_change"), F.lit(0.0)) + shift, 0.0, 100.0))))
    d = d.withColumn("momentum", _avg(step_score("year_return", YEAR_RETURN, 20), step_score("year_position", YEAR_POSITION, 25)))
    d = d.withColumn("score", weighted_available([(c("quality"), 30.0), (c("valuation"), 25.0), (c("direction"), 20.0), (c("analyst"), 15.0), (c("momentum"), 10.0)]))
    facts = sum((F.col(x).isNotNull().cast("int") for x in ("pe", "roe", "margin", "revenue_growth", "earnings_growth", "analyst_score", "year_position")), F.lit(0))
    confidence = (F.when(~c("identity_resolved") | c("filing_conflict"), "Low").when((facts >= 5) & (c("analyst_count") >= 5), F.when(c("filing_agrees"), "High").otherwise("Medium")).otherwise("Low"))
    d = d.withColumn("confidence", confidence)
    severe = (c("revenue_growth") < -12) & (c("earnings_growth") < -18)
    weak = (c("quality") < 38) & (c("direction") < 38) & F.coalesce(c("analyst") < 45, F.lit(True))
    good = (c("score") >= 68) & (c("valuation") >= 48) & (c("direction") >= 58)
    ultra = (c("score") >= 86) & (c("quality") >= 78) & (c("valuation") >= 70) & (c("direction") >= 72) & (c("analyst") >= 70)
    sell = (F.coalesce(severe, F.lit(False)) | F.coalesce(weak, F.lit(False))) & (c("score") < 43)
    return d.withColumn("action", F.when(F.coalesce(sell, F.lit(False)), "Sell").when((c("confidence") == "Medium") & good, "Buy")
                        .when((c("confidence") == "High") & good, F.when(F.coalesce(ultra, F.lit(False)), "Ultra Buy").otherwise("Buy")).otherwise("Hold"))


#: Instruments that are no companies: they count neither as holdings of the neutral weight nor as ranked ones.
FUND, CRYPTO = "fund", "crypto"


def weight_review(positions: DataFrame, portfolio="portfolio") -> DataFrame:
    """Over, under or balanced against the neutral weight of the portfolio, the mean weight of its companies; funds, coins and companies
    without a rank are reviewed separately."""
    c = F.col
    company = (c("weight") > 0) & ~F.coalesce(c("instrument").isin(FUND, CRYPTO), F.lit(False))
    n = positions.filter(company).groupBy(portfolio).agg(F.avg("weight").alias("neutral"))
    overlap, heavy = F.coalesce(c("average_correlation") >= 0.75, F.lit(False)), F.coalesce(c("risk_contribution") > c("weight") * 1.5, F.lit(False))
    over = (c("weight") > c("neutral") * 2) | ((c("weight") > c("neutral") * 1.5) & ((c("score") < 55) | (c("confidence") == "Low") | overlap | heavy))
    under = (c("weight") < c("neutral") * 0.5) & (c("score") >= 70) & (c("confidence") != "Low") & ~overlap
    separate = c("score").isNull() | c("neutral").isNull() | F.coalesce(c("instrument").isin(FUND, CRYPTO), F.lit(False))
    review = F.when(separate, "separate").when(F.coalesce(over, F.lit(False)), "over").when(F.coalesce(under, F.lit(False)), "under").otherwise("balanced")
    return positions.join(n, portfolio, "left").withColumn("review", review)


def compare_opportunity(ideas: DataFrame, owned: DataFrame, portfolio="portfolio") -> DataFrame:
    """Replacement of the weakest holding that is no fund, diversification, or watch. ``ideas`` has portfolio, symbol, score, sector.

    A holding without a score stands in the middle of its action's holdings, but nothing is known to be better than it."""
    order = F.create_map(*[F.lit(x) for x in ("Sell", 0, "Hold", 1, "Buy", 2, "Ultra Buy", 3)])
    held = owned.where((F.col("weight") > 0) & ~F.coalesce(F.col("instrument") == FUND, F.lit(False)))
    place = F.struct(F.try_element_at(order, F.col("action")).alias("a"), F.coalesce("score", F.lit(50.0)).alias("s"), F.col("symbol").alias("w"), F.col("score").alias("known"))
    weakest = held.groupBy(portfolio).agg(F.min(place).alias("_w"))
    sector = owned.groupBy(portfolio, "sector").agg(F.sum("weight").alias("sector_weight"))
    j = ideas.join(weakest, portfolio, "left").join(sector, [portfolio, "sector"], "left")
    gain = F.col("score") - F.col("_w.known")
    kind = F.when(gain >= 8, "replacement").when(F.coalesce("sector_weight", F.lit(0.0)) < 8, "diversification").otherwise("watch")
    return j.withColumn("advantage", gain).withColumn("kind", kind).withColumn("weakest", F.col("_w.w")).drop("_w")
