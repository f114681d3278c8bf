"""As-filed fundamentals: which facts may be used, trailing-twelve-month bridges, balances, multiples and DCF scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clamp, finite
from tidemark.operators.joins import _fill, _instant, nearest

# Forms whose facts count, and those that close a year.
ALLOWED_FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K")
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")


def eligible_facts(facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Flow facts with an allowed form, a plausible duration and a finite value, filed by ``as_of`` when given."""
    d = F.datediff("end", "start")
    ok = F.col("form").isin(*ALLOWED_FORMS) & F.col("filed").isNotNull() & d.between(20, 430) & finite("val").isNotNull()
    if as_of is not None:
        ok = ok & (F.col("filed") <= as_of)
    return facts.filter(ok).withColumn("duration", d)


def select_tag(facts: DataFrame, tags: list[str], units: list[str], by_recency: bool = True) -> DataFrame:
    """Facts of the one (unit, tag) each entity is read in: the first unit it uses, then the most recently filed tag
    (earlier in the list on ties), or simply the first tag when ``by_recency`` is off."""
    def rank(col, items):
        return F.array_position(F.array(*[F.lit(i) for i in items]), F.col(col))
    seen = facts.filter(F.col("tag").isin(tags) & F.col("unit").isin(units)).groupBy("entity", "unit", "tag").agg(F.max("filed").alias("_latest"))
    unit, tag, recent = rank("unit", units), rank("tag", tags), -F.unix_date("_latest")
    order = F.struct(unit, recent, tag) if by_recency else F.struct(tag, unit)
    best = seen.groupBy("entity").agg(F.min_by(F.struct("unit", "tag"), order).alias("b")).select("entity", "b.unit", "b.tag")
    return facts.join(best, ["entity", "unit", "tag"], "left_semi")


def _running(left: DataFrame, right: DataFrame, keys: list[str], payload: Column, name: str) -> DataFrame:
    """Greatest payload among right rows filed on or before each left row's day."""
    out = _fill(left, right, keys, _instant("as_of"), _instant("filed"), payload, True, latest=False, bucket=None)
    return out.withColumnRenamed("_hit", name)


def ttm_as_of(facts: DataFrame, as_of: DataFrame, keys: tuple[str, ...] = ("entity", "metric")) -> DataFrame:
    """Trailing twelve months per key and day from facts filed by that day.

    The bridge annual + current year-to-date - prior year-to-date only combines numbers of one filing, so every filing is
    reduced to its (current, prior) pair once. What is left per key is one annual and one interim row per filing day, and
    both "latest known" choices become running maxima. ``as_of`` has the keys and an ``as_of`` date.
    """
    k = list(keys)
    rows = eligible_facts(facts)
    annual_form = F.col("form").isin(*ANNUAL_FORMS)
    annual = rows.filter(annual_form & F.col("duration").between(300, 430)).groupBy(*k, "filed").agg(
        F.max(F.struct("end", F.col("filed").alias("on"), "val", "form", "accn")).alias("p"))
    interim = F.when(~annual_form & (F.col("duration") <= 300), F.col("end"))
    own = rows.groupBy(*k, "filed", "accn").agg(F.max(interim).alias("own_end")).filter("own_end IS NOT NULL")
    filing = rows.join(own, [*k, "filed", "accn"])
    w = Window.partitionBy(*k, "filed", "own_end")
    current = F.max(F.when((F.col("end") == F.col("own_end")) & (F.col("duration") <= 300), F.struct("duration", "accn", "val", "form"))).over(w)
    filing = filing.withColumn("_cur", current)
    gap, drift = F.datediff("own_end", "end"), F.abs(F.col("duration") - F.col("_cur.duration"))
    comparable = gap.between(300, 430) & (drift <= 35)
    pairs = filing.groupBy(*k, "filed", "own_end").agg(
        F.max("_cur").alias("_cur"), F.min(F.when(comparable, F.struct(F.abs(gap - 365).alias("g"), drift.alias("d"), F.col("accn"), F.col("val")))).alias("_prior"))
    pairs = pairs.select(*k, "filed", F.struct(F.col("own_end").alias("end"), F.col("filed").alias("on"), F.col("_cur.val").alias("cur"), F.col("_prior.val").alias("prior"),
                                               F.col("_cur.form").alias("form"), F.col("_cur.accn").alias("accn")).alias("p"))
    out = _running(as_of, annual, k, F.col("p"), "_a")
    out = _running(out, pairs, k, F.col("p"), "_i").filter(F.col("_a").isNotNull())
    bridge = F.coalesce((F.col("_i.end") > F.col("_a.end")) & F.col("_i.prior").isNotNull() & F.col("_i.cur").isNotNull(), F.lit(False))
    return (out.withColumn("ttm", F.when(bridge, F.col("_a.val") + F.col("_i.cur") - F.col("_i.prior")).otherwise(F.col("_a.val")))
            .withColumn("period_end", F.when(bridge, F.col("_i.end")).otherwise(F.col("_a.end")))
            .withColumn("filed", F.when(bridge, F.col("_i.on")).otherwise(F.col("_a.on")))
            .withColumn("form", F.when(bridge, F.col("_i.form")).otherwise(F.col("_a.form")))
            .withColumn("method", F.when(bridge, "bridge").otherwise("annual")).drop("_a", "_i"))


def latest_fact(facts: DataFrame, as_of: DataFrame, keys: tuple[str, ...] = ("entity", "metric"), positive: bool = True) -> DataFrame:
    """Latest balance by (period end, filing day) filed by each day."""
    floor = F.col("val") > 0 if positive else F.col("val") >= 0
    rows = facts.filter(F.col("form").isin(*ALLOWED_FORMS) & finite("val").isNotNull() & floor & F.col("end").isNotNull())
    out = _running(as_of, rows, list(keys), F.struct("end", F.col("filed").alias("on"), "val", "accn"), "_p").filter(F.col("_p").isNotNull())
    return (out.withColumn("value", F.col("_p.val")).withColumn("period_end", F.col("_p.end")).withColumn("filed", F.col("_p.on")).drop("_p"))


# For each balance, alternatives in order of preference; an alternative counts only when all parts exist.
INSTANT_METRICS = {
    "cash": [["us-gaap:CashAndCashEquivalentsAtCarryingValue"], ["ifrs-full:CashAndCashEquivalents"]],
    "debt": [["us-gaap:LongTermDebtCurrent", "us-gaap:LongTermDebtNoncurrent", "us-gaap:ShortTermBorrowings"],
             ["ifrs-full:CurrentBorrowings", "ifrs-full:NoncurrentBorrowings"]],
    "leases": [["us-gaap:OperatingLeaseLiabilityCurrent", "us-gaap:OperatingLeaseLiabilityNoncurrent",
                "us-gaap:FinanceLeaseLiabilityCurrent", "us-gaap:FinanceLeaseLiabilityNoncurrent"],
               ["us-gaap:OperatingLeaseLiability", "us-gaap:FinanceLeaseLiability"], ["ifrs-full:LeaseLiabilities"]],
    "minority": [["us-gaap:MinorityInterest"],
                 ["us-gaap:NoncontrollingInterestInConsolidatedEntity", "us-gaap:RedeemableNoncontrollingInterestEquityCarryingAmount"],
                 ["ifrs-full:NoncontrollingInterests"]],
}
BORROWING_ALTERNATIVES = [
    (["us-gaap:ProceedsFromIssuanceOfDebt"], ["us-gaap:RepaymentsOfDebt"]),
    (["us-gaap:ProceedsFromIssuanceOfLongTermDebt", "us-gaap:ProceedsFromShortTermDebt"],
     ["us-gaap:RepaymentsOfLongTermDebt", "us-gaap:RepaymentsOfShortTermDebt"]),
    (["ifrs-full:ProceedsFromBorrowings"], ["ifrs-full:RepaymentsOfBorrowings"]),
]


def _parts(as_of: DataFrame, parts: list[tuple]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("alt"), F.lit(t).alias("tag"), F.lit(n).alias("need"), F.lit(s).alias("sign"))
                      for m, i, t, n, s in parts])
    return as_of.select("entity", "as_of", F.explode(cells).alias("c")).select("entity", "as_of", "c.*")


def _first_complete(found: DataFrame, value: Column) -> DataFrame:
    """Lowest alternative of which every part exists at one common period end."""
    per = found.groupBy("entity", "as_of", "metric", "alt").agg(
        F.count(F.lit(1)).alias("_k"), F.max("need").alias("need"), F.min("period_end").alias("_e0"), F.max("period_end").alias("period_end"),
        F.sum(value).alias("value"), F.max("filed").alias("filed"))
    good = per.filter((F.col("_k") == F.col("need")) & (F.col("_e0") == F.col("period_end")))
    best = good.groupBy("entity", "as_of", "metric").agg(F.min_by(F.struct("alt", "value", "period_end", "filed"), "alt").alias("b"))
    return best.select("entity", "as_of", "metric", "b.*")


def instant_metrics(facts: DataFrame, as_of: DataFrame, metrics: dict = INSTANT_METRICS) -> DataFrame:
    parts = [(m, i, t, len(alt), 1.0) for m, alts in metrics.items() for i, alt in enumerate(alts) for t in alt]
    asked = _parts(as_of, parts)
    found = latest_fact(facts, asked, ("entity", "tag"), positive=False)
    return _first_complete(found, F.col("value"))


def net_borrowing(facts: DataFrame, as_of: DataFrame, alternatives: list = BORROWING_ALTERNATIVES) -> DataFrame:
    """Debt proceeds minus repayments over one matching trailing period."""
    parts = [("net_borrowing", i, t, len(p) + len(r), s) for i, (p, r) in enumerate(alternatives) for tags, s in ((p, 1.0), (r, -1.0)) for t in tags]
    found = ttm_as_of(facts, _parts(as_of, parts), ("entity", "tag"))
    return _first_complete(found, F.when(F.col("sign") > 0, F.col("ttm")).otherwise(-F.abs("ttm")))


def financing(facts: DataFrame, as_of: DataFrame) -> DataFrame:
    """Net debt-like claims, only when all four balances share one date, and matched net borrowing."""
    both = instant_metrics(facts, as_of).select("entity", "as_of", "metric", "value", "period_end").unionByName(
        net_borrowing(facts, as_of).select("entity", "as_of", "metric", "value", "period_end"))
    def pick(m, c="value"):
        return F.max(F.when(F.col("metric") == m, F.col(c)))
    balance = F.col("metric") != "net_borrowing"
    per = both.groupBy("entity", "as_of").agg(
        *[pick(m).alias(m) for m in ("cash", "debt", "leases", "minority", "net_borrowing")], F.count_if(balance).alias("_k"),
        F.min(F.when(balance, F.col("period_end"))).alias("_e0"), F.max(F.when(balance, F.col("period_end"))).alias("_e1"))
    ok = (F.col("_k") == 4) & (F.col("_e0") == F.col("_e1"))
    return (per.withColumn("balance_ready", ok).withColumn("net_claims", F.when(ok, F.col("debt") + F.col("leases") + F.col("minority") - F.col("cash")))
            .withColumn("ready", ok & F.col("net_borrowing").isNotNull()).drop("_k", "_e0", "_e1"))


def percentile_rank_mid(history: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """(below + half of the equal) / n of each target among its own history; 0.5 without history."""
    j = target.select(key, F.col(value).alias("_t")).join(history.select(key, F.col(value).alias("_v")), key, "left")
    out = j.groupBy(key).agg(F.first("_t").alias(value), F.count("_v").alias("observations"),
                             ((F.count_if(F.col("_v") < F.col("_t")) + F.count_if(F.col("_v") == F.col("_t")) * 0.5) / F.nullif(F.count("_v"), F.lit(0))).alias("_p"))
    return out.withColumn("percentile", F.coalesce("_p", F.lit(0.5))).drop("_p")


def range_verdict(rank: Column) -> Column:
    return F.when(rank.isNull(), "not enough history").when(rank <= 0.25, "cheaper than usual").when(rank <= 0.75, "within its own range").otherwise("more expensive than usual")


def filing_days(facts: DataFrame) -> DataFrame:
    return facts.select("entity", F.col("filed").alias("as_of")).distinct()


def fcf_history(facts: DataFrame, prices: DataFrame, fx: DataFrame | None = None) -> DataFrame:
    """Free cash flow, shares, market value and multiples at every filing day, priced within a week after it.

    ``facts`` carries metric cfo, capex and shares; ``prices`` has entity, session_date, close and split_share_factor.
    """
    days = filing_days(facts)
    ask = days.withColumn("metric", F.explode(F.array(F.lit("cfo"), F.lit("capex"))))
    flows = ttm_as_of(facts.filter(F.col("metric").isin("cfo", "capex")), ask).groupBy("entity", "as_of").agg(
        F.max(F.when(F.col("metric") == "cfo", F.col("ttm"))).alias("operating"), F.max(F.when(F.col("metric") == "capex", F.abs("ttm"))).alias("investment"),
        F.max("filed").alias("_filed"))
    shares = latest_fact(facts.filter("metric = 'shares'"), days.withColumn("metric", F.lit("shares"))).select("entity", "as_of", F.col("value").alias("share_count"))
    rows = flows.filter("operating IS NOT NULL AND investment IS NOT NULL").join(shares, ["entity", "as_of"])
    cols = ["close", "split_share_factor"]
    rows = nearest(rows, prices, "entity", "as_of", "session_date", cols, "after", 7).filter("close IS NOT NULL").withColumnRenamed("matched_ts", "price_date")
    if fx is not None:
        units = facts.filter("metric = 'cfo'").groupBy("entity").agg(F.max("unit").alias("currency"))
        from tidemark.operators.joins import fx_convert
        rows = fx_convert(rows.join(units, "entity"), fx, ["operating", "investment"], "price_date").filter("operating IS NOT NULL").drop("currency")
    rows = (rows.withColumn("fcf", F.col("operating") - F.col("investment")).withColumn("traded_shares", F.col("share_count") * F.col("split_share_factor"))
            .withColumn("market_value", F.col("close") * F.col("traded_shares")).filter("market_value > 0"))
    multiple = F.when(F.col("fcf") > 0, F.col("market_value") / F.col("fcf"))
    return rows.withColumn("price_to_fcf", multiple).withColumn("fcf_yield", 100 / F.col("price_to_fcf"))


def pe_history(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Price over split-normalised trailing earnings at every filing day; only 0 < P/E <= 300 is kept."""
    eps = ttm_as_of(facts.filter("metric = 'eps'"), filing_days(facts.filter("metric = 'eps'")).withColumn("metric", F.lit("eps")))
    rows = nearest(eps.select("entity", "as_of", "ttm", "method"), prices, "entity", "as_of", "session_date", ["close", "split_share_factor"], "after", 7)
    rows = rows.withColumn("eps", F.col("ttm") / F.col("split_share_factor")).filter("close IS NOT NULL AND eps > 0")
    return rows.withColumn("pe", F.col("close") / F.col("eps")).filter("pe > 0 AND pe <= 300").withColumnRenamed("matched_ts", "price_date")


def own_range(history: DataFrame, value: str, minimum: int = 5) -> DataFrame:
    """Newest multiple of each entity against its own earlier ones."""
    newest = F.struct("as_of", value)
    last = history.filter(F.col(value).isNotNull()).groupBy("entity").agg(F.max(newest).alias("l")).select("entity", F.col("l.as_of").alias("_last"), F.col(f"l.{value}").alias(value))
    earlier = history.filter(F.col(value).isNotNull()).join(last.select("entity", "_last"), "entity").filter(F.col("as_of") < F.col("_last"))
    out = percentile_rank_mid(earlier, last, "entity", value)
    rank = F.when(F.col("observations") >= minimum, F.col("percentile"))
    return out.withColumn("percentile", rank).withColumn("verdict", range_verdict(F.col("percentile")))


def annual_per_share(history: DataFrame, amount: str = "fcf", shares: str = "traded_shares", day: str = "as_of") -> DataFrame:
    """Last usable observation per calendar year, per share."""
    rows = history.filter((F.col(amount) > 0) & (F.col(shares) > 0))
    return rows.groupBy("entity", F.year(day).alias("year")).agg(F.max_by(F.col(amount) / F.col(shares), day).alias("per_share"))


# Fixed values of the discounted cash-flow policy.
RISK_FREE_FLOOR, DISCOUNT_FLOOR, RISK_PREMIUM, MAX_BASE_GROWTH, MAX_STRONG_GROWTH = 4.5, 10.5, 5.5, 8.0, 10.0
MIN_ANNUAL_POINTS, MAX_TERMINAL_SHARE, FORECAST_YEARS = 3, 80.0, 5


def _median_of(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def growth_anchor(annual: DataFrame) -> DataFrame:
    """Median of the last five clamped yearly growth rates in percent, and the recent per-share amounts."""
    w = Window.partitionBy("entity").orderBy("year")
    prev, prev_year = F.lag("per_share").over(w), F.lag("year").over(w)
    g = F.pow(F.col("per_share") / prev, 1.0 / (F.col("year") - prev_year)) - 1
    rows = annual.withColumn("_g", F.when((prev > 0) & (F.col("per_share") > 0), clamp(g, -0.5, 0.5)))
    per = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("points"), F.sort_array(F.collect_list(F.struct("year", "_g", "per_share"))).alias("a"))
    growths = F.filter(F.col("a._g"), lambda x: x.isNotNull())
    recent = F.slice(growths, F.greatest(F.lit(1), F.size(growths) - 4), 5)
    last3 = F.slice(F.col("a.per_share"), F.greatest(F.lit(1), F.size("a") - 2), 3)
    return per.select("entity", "points", clamp(F.when(F.size(growths) > 0, _median_of(recent) * 100).otherwise(0.0), 0.0, MAX_BASE_GROWTH).alias("base_growth"),
                      _median_of(last3).alias("recent_median"))


def dcf_scenarios(companies: DataFrame, start: str = "start_cash", risk_free: float = RISK_FREE_FLOOR) -> DataFrame:
    """Three scenarios per company as plain arithmetic: value, terminal share and distance from the price.

    ``companies`` has start_cash (per share), base_growth, used_beta, price and points.
    """
    disc = F.greatest(F.lit(DISCOUNT_FLOOR), F.lit(max(RISK_FREE_FLOOR, risk_free)) + F.col("used_beta") * RISK_PREMIUM)
    g = F.col("base_growth")
    terms = [("downside", F.greatest(F.lit(-5.0), F.least(F.lit(0.0), g - 6.0)), disc + 2.0, 1.5, 0.8), ("base", g, disc, 2.0, 1.0),
             ("strong", F.least(F.lit(MAX_STRONG_GROWTH), g + 3.0), F.greatest(F.lit(9.5), disc - 1.0), 2.5, 1.0)]
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), gr.alias("growth"), d.alias("discount"), F.lit(t).alias("terminal_growth"), (F.col(start) * k).alias("start"))
                                for n, gr, d, t, k in terms]))
    rows = companies.filter(F.col(start) > 0).withColumn("_c", cases).select(*companies.columns, "_c.*")
    step = (1 + F.col("growth") / 100) / (1 + F.col("discount") / 100)
    flow = reduce(lambda a, b: a + b, [F.col("start") * F.pow(step, F.lit(float(y))) for y in range(1, FORECAST_YEARS + 1)])
    last = F.col("start") * F.pow(step, F.lit(float(FORECAST_YEARS)))
    terminal = last * (1 + F.col("terminal_growth") / 100) / ((F.col("discount") - F.col("terminal_growth")) / 100)
    rows = rows.withColumn("forecast_value", flow).withColumn("terminal_value", terminal).withColumn("value", F.col("forecast_value") + F.col("terminal_value"))
    return (rows.withColumn("terminal_share", F.col("terminal_value") / F.col("value") * 100).withColumn("versus_price", (F.col("value") / F.col("price") - 1) * 100)
            .withColumn("ready", (F.col("points") >= MIN_ANNUAL_POINTS) & (F.max(F.when(F.col("scenario") == "base", F.col("terminal_share"))).over(Window.partitionBy("entity")) <= MAX_TERMINAL_SHARE)))


def dcf_readiness(scenarios: DataFrame) -> DataFrame:
    base = scenarios.filter("scenario = 'base'")
    return base.agg(F.count(F.lit(1)).alias("companies"), F.count_if("ready").alias("ready"), F.count_if(F.col("versus_price") > 0).alias("above_price"))


def investment_split(companies: DataFrame) -> DataFrame:
    """Owner-cash scenarios: only spending above depreciation may count as growth, none of it in the downside."""
    possible = F.greatest(F.lit(0.0), F.col("capex") - F.col("depreciation"))
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("share")) for n, s in (("downside", 0.0), ("base", 0.5), ("strong", 1.0))]))
    rows = companies.filter("capex IS NOT NULL AND operating IS NOT NULL AND depreciation > 0 AND quality = 'moderate'").withColumn("_c", cases)
    growth = possible * F.col("_c.share")
    return rows.select("entity", F.col("_c.scenario").alias("scenario"), growth.alias("growth_investment"), (F.col("capex") - growth).alias("maintenance_investment"),
                       (F.col("operating") - F.col("capex") + growth).alias("owner_cash"))


def filing_check(facts: DataFrame, market: DataFrame, growth_tolerance: float = 15.0, margin_tolerance: float = 8.0) -> DataFrame:
    """Current and prior comparable period of every filing, growth and margin, checked against market figures.

    ``facts`` carries metric revenue and income; within one filing the current period is the latest end (longest duration
    on ties) and the prior one is closest to a year earlier with a similar duration.
    """
    rows = eligible_facts(facts.filter(F.col("metric").isin("revenue", "income")))
    k = ["entity", "accn", "filed", "metric"]
    w = Window.partitionBy(*k)
    rows = rows.withColumn("_cur", F.max(F.struct("end", "duration", "val")).over(w))
    gap = F.datediff(F.col("_cur.end"), "end")
    near = gap.between(300, 430) & (F.abs(F.col("duration") - F.col("_cur.duration")) <= 35)
    per = rows.groupBy(*k).agg(F.max("_cur").alias("c"), F.min(F.when(near, F.struct(F.abs(gap - 365).alias("g"), "val"))).alias("p"))
    def at(m, f):
        return F.max(F.when(F.col("metric") == m, F.col(f)))
    wide = per.groupBy("entity", "accn", "filed").agg(at("revenue", "c.val").alias("revenue"), at("revenue", "p.val").alias("prior_revenue"),
                                                      at("income", "c.val").alias("income"), F.max(F.col("c.end")).alias("period_end"))
    wide = (wide.withColumn("growth", F.when(F.col("prior_revenue") > 0, (F.col("revenue") / F.col("prior_revenue") - 1) * 100))
            .withColumn("margin", F.when(F.col("revenue") > 0, F.col("income") / F.col("revenue") * 100)))
    j = wide.join(market, "entity", "left")
    def check(a, b, limit):
        return F.when(F.col(a).isNull() | F.col(b).isNull(), "unavailable").when(F.abs(F.col(a) - F.col(b)) <= limit, "agrees").otherwise("review")
    return j.withColumn("growth_check", check("growth", "market_growth", growth_tolerance)).withColumn("margin_check", check("margin", "market_margin", margin_tolerance))
