"""Queries over as-filed facts, multiples, DCF, macro and analysts."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import cents, view
from tidemark.operators import analysts
from tidemark.plans import fundamentals as fu, macro

TODAY = "2001-12-31"


@view("quarters", """
SELECT 'N' || c_nationkey AS entity, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0 AS v, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def _quarters(v):
    d = F.col("o_orderdate")
    return (v.table("orders").join(v.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity"), F.year(d).alias("y"), F.quarter(d).alias("q"))
            .agg((cents("o_totalprice").cast("double") / 100.0).alias("v"), F.count(F.lit(1)).alias("n")))


@view("flows", """
SELECT entity, y, q, make_date(y, 1, 1) AS start, CAST(make_date(y, 1, 1) + (q*3) * INTERVAL 1 MONTH AS DATE) - 1 AS "end",
 sum(v) OVER (PARTITION BY entity, y ORDER BY q) AS val, n FROM quarters""")
def _flows(v):
    from pyspark.sql import Window
    start = F.make_date("y", F.lit(1), F.lit(1))
    return v.quarters.select("entity", "y", "q", start.alias("start"), F.date_sub(F.add_months(start, F.col("q") * 3), 1).alias("end"),
                             F.sum("v").over(Window.partitionBy("entity", "y").orderBy("q")).alias("val"), "n")


# Every filing repeats the comparable period of the year before; the year closes with an annual form.
_MET = [("cfo", 1.0), ("capex", -0.3), ("revenue", 2.0), ("income", 0.2), ("eps", 1e-7)]
_METV = ", ".join(f"('{m}', {k}e0)" if "e" not in repr(k) else f"('{m}', {k})" for m, k in _MET)


@view("flow_facts", f"""
SELECT f.entity, m.metric, 'us-gaap:' || m.metric AS tag, CASE WHEN f.entity IN ('N3','N7') AND m.metric <> 'eps' THEN 'EUR' ELSE 'USD' END AS unit, p.start, p."end", p.val*m.k AS val, filed, form, accn FROM (
 SELECT entity, y, q, "end" + CASE WHEN q = 4 THEN 75 ELSE 45 END AS filed, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form, entity || '-' || y || '-' || q AS accn FROM flows) f
JOIN flows p ON p.entity = f.entity AND p.q = f.q AND p.y IN (f.y, f.y-1), (VALUES {_METV}) m(metric, k)""")
def _flow_facts(v):
    f = v.flows
    late = F.when(F.col("q") == 4, 75).otherwise(45)
    filings = f.select("entity", "y", "q", F.date_add("end", late).alias("filed"), F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form"),
                       F.concat_ws("-", "entity", "y", "q").alias("accn"), F.explode(F.array("y", F.col("y") - 1)).alias("py"))
    periods = f.select("entity", F.col("y").alias("py"), "q", "start", "end", "val")
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k")) for m, k in _MET])).alias("m")
    j = filings.join(periods, ["entity", "py", "q"]).select("*", metric)
    euro = F.col("entity").isin("N3", "N7") & (F.col("m.metric") != "eps")
    return j.select("entity", F.col("m.metric").alias("metric"), F.concat(F.lit("us-gaap:"), F.col("m.metric")).alias("tag"), F.when(euro, "EUR").otherwise("USD").alias("unit"),
                    "start", "end", (F.col("val") * F.col("m.k")).alias("val"), "filed", "form", "accn")


_BAL = [("us-gaap:CashAndCashEquivalentsAtCarryingValue", 10, 1), ("us-gaap:LongTermDebtCurrent", 3, 1), ("us-gaap:LongTermDebtNoncurrent", 5, 1), ("us-gaap:ShortTermBorrowings", 2, 1),
        ("us-gaap:OperatingLeaseLiability", 2, 1), ("us-gaap:FinanceLeaseLiability", 1, 1), ("us-gaap:OperatingLeaseLiabilityCurrent", 1, 2), ("us-gaap:MinorityInterest", 1, 1),
        ("ifrs-full:NoncontrollingInterests", 4, 2), ("shares", 1000, 1)]


@view("balance_facts", f"""
SELECT entity, CASE WHEN tag = 'shares' THEN 'shares' END AS metric, tag, 'USD' AS unit, CAST(NULL AS DATE) AS start, "end", CAST(n*k AS DOUBLE) AS val, "end" + CASE WHEN q = 4 THEN 75 ELSE 45 END AS filed,
 CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form, entity || '-' || y || '-' || q AS accn FROM flows, (VALUES {", ".join(f"('{t}', {k}, {s})" for t, k, s in _BAL)}) b(tag, k, step) WHERE q % step = 0""")
def _balance_facts(v):
    tag = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(k).alias("k"), F.lit(s).alias("step")) for t, k, s in _BAL])).alias("b")
    j = v.flows.select("*", tag).filter(F.col("q") % F.col("b.step") == 0)
    late = F.when(F.col("q") == 4, 75).otherwise(45)
    return j.select("entity", F.when(F.col("b.tag") == "shares", "shares").alias("metric"), F.col("b.tag").alias("tag"), F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("start"), "end",
                    (F.col("n") * F.col("b.k")).cast("double").alias("val"), F.date_add("end", late).alias("filed"), F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form"),
                    F.concat_ws("-", "entity", "y", "q").alias("accn"))


@query("fact_eligible", "facts:l entities:l first_filed:d total:f0", """
SELECT count(*) AS facts, count(DISTINCT entity) AS entities, min(filed) AS first_filed, sum(val) AS total FROM flow_facts WHERE filed <= DATE '1999-06-30' AND "end" - start BETWEEN 20 AND 430""")
def _(v):
    e = fu.eligible_facts(v.flow_facts, F.lit("1999-06-30").cast("date"))
    return e.agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("entity").alias("entities"), F.min("filed").alias("first_filed"), F.sum("val").alias("total"))


@query("facts_tag_select", "entity:s unit:s tag:s facts:l", """
SELECT entity, unit, tag, count(*) AS facts FROM flow_facts f WHERE (entity, unit, tag) IN (SELECT (entity, unit, tag) FROM (
 SELECT entity, unit, tag, row_number() OVER (PARTITION BY entity ORDER BY CASE unit WHEN 'USD' THEN 1 ELSE 2 END, latest DESC, CASE tag WHEN 'us-gaap:income' THEN 1 WHEN 'us-gaap:cfo' THEN 2 ELSE 3 END) AS rn
 FROM (SELECT entity, unit, tag, max(filed) AS latest FROM flow_facts WHERE tag IN ('us-gaap:income','us-gaap:cfo','us-gaap:eps') GROUP BY 1, 2, 3)) WHERE rn = 1) GROUP BY 1, 2, 3""")
def _(v):
    s = fu.select_tag(v.flow_facts, ["us-gaap:income", "us-gaap:cfo", "us-gaap:eps"], ["USD", "EUR"])
    return s.groupBy("entity", "unit", "tag").agg(F.count(F.lit(1)).alias("facts"))


TTM = """
SELECT a.entity, a.metric, a.as_of, CASE WHEN i.cur IS NOT NULL AND i.prior IS NOT NULL AND i."end" > n."end" THEN n.val + i.cur - i.prior ELSE n.val END AS ttm,
 CASE WHEN i.cur IS NOT NULL AND i.prior IS NOT NULL AND i."end" > n."end" THEN i."end" ELSE n."end" END AS period_end, CASE WHEN i.cur IS NOT NULL AND i.prior IS NOT NULL AND i."end" > n."end" THEN 'bridge' ELSE 'annual' END AS method
FROM (SELECT DISTINCT entity, metric, filed AS as_of FROM flow_facts) a
JOIN (SELECT DISTINCT ON (a.entity, a.metric, a.as_of) a.entity, a.metric, a.as_of, f."end", f.val FROM (SELECT DISTINCT entity, metric, filed AS as_of FROM flow_facts) a
  JOIN flow_facts f ON f.entity = a.entity AND f.metric = a.metric AND f.filed <= a.as_of AND f.form = '10-K' AND f."end" - f.start BETWEEN 300 AND 430 ORDER BY a.entity, a.metric, a.as_of, f."end" DESC, f.filed DESC) n
  ON n.entity = a.entity AND n.metric = a.metric AND n.as_of = a.as_of
LEFT JOIN (SELECT DISTINCT ON (a.entity, a.metric, a.as_of) a.entity, a.metric, a.as_of, f."end", f.val AS cur, p.val AS prior FROM (SELECT DISTINCT entity, metric, filed AS as_of FROM flow_facts) a
  JOIN flow_facts f ON f.entity = a.entity AND f.metric = a.metric AND f.filed <= a.as_of AND f.form = '10-Q' AND f."end" - f.start BETWEEN 20 AND 300
  LEFT JOIN flow_facts p ON p.accn = f.accn AND p.metric = f.metric AND f."end" - p."end" BETWEEN 300 AND 430 ORDER BY a.entity, a.metric, a.as_of, f."end" DESC, f.filed DESC) i
  ON i.entity = a.entity AND i.metric = a.metric AND i.as_of = a.as_of"""


@view("ttm_rows", TTM)
def _ttm_rows(v):
    return fu.ttm_as_of(v.flow_facts, v.flow_facts.select("entity", "metric", F.col("filed").alias("as_of")).distinct())


@query("ttm_as_of", "entity:s metric:s as_of:d ttm:f2 period_end:d method:s", "SELECT * FROM ttm_rows")
def _(v):
    return v.ttm_rows


@query("shares_as_of", "entity:s as_of:d value:f2 period_end:d", """
SELECT DISTINCT ON (a.entity, a.as_of) a.entity, a.as_of, f.val AS value, f."end" AS period_end FROM (SELECT DISTINCT entity, filed + 10 AS as_of FROM balance_facts) a
JOIN balance_facts f ON f.entity = a.entity AND f.tag = 'shares' AND f.filed <= a.as_of AND f.val > 0 ORDER BY a.entity, a.as_of, f."end" DESC, f.filed DESC""")
def _(v):
    asks = v.balance_facts.select("entity", F.date_add("filed", 10).alias("as_of"), F.lit("shares").alias("metric")).distinct()
    return fu.latest_fact(v.balance_facts.filter("metric = 'shares'"), asks)


_PARTS = [(m, i, t, len(alt)) for m, alts in fu.INSTANT_METRICS.items() for i, alt in enumerate(alts) for t in alt]


@view("instants", f"""
SELECT entity, as_of, metric, arg_min(value, alt) AS value, arg_min(pe, alt) AS period_end FROM (
 SELECT entity, as_of, metric, alt, sum(val) AS value, max("end") AS pe FROM (
  SELECT DISTINCT ON (a.entity, a.as_of, p.metric, p.alt, p.tag) a.entity, a.as_of, p.metric, p.alt, p.need, f.val, f."end" FROM (SELECT DISTINCT entity, filed AS as_of FROM balance_facts) a
  JOIN balance_facts f ON f.entity = a.entity AND f.filed <= a.as_of AND f.val >= 0 JOIN (VALUES {", ".join(f"('{m}', {i}, '{t}', {n})" for m, i, t, n in _PARTS)}) p(metric, alt, tag, need) ON p.tag = f.tag
  ORDER BY a.entity, a.as_of, p.metric, p.alt, p.tag, f."end" DESC, f.filed DESC) GROUP BY 1, 2, 3, 4 HAVING count(*) = max(need) AND count(DISTINCT "end") = 1) GROUP BY 1, 2, 3""")
def _instants(v):
    return fu.instant_metrics(v.balance_facts, fu.filing_days(v.balance_facts))


@query("instant_metric", "entity:s as_of:d metric:s value:f2 period_end:d", "SELECT * FROM instants")
def _(v):
    return v.instants


@query("financing_evidence", "entity:s as_of:d cash:f2 debt:f2 net_claims:f2 net_borrowing:f2 balance_ready:b ready:b", """
SELECT entity, as_of, max(value) FILTER (WHERE metric='cash') AS cash, max(value) FILTER (WHERE metric='debt') AS debt, any_value(nb) AS net_borrowing,
 CASE WHEN count(*) = 4 AND count(DISTINCT period_end) = 1 THEN sum(CASE WHEN metric='cash' THEN -value ELSE value END) END AS net_claims,
 count(*) = 4 AND count(DISTINCT period_end) = 1 AS balance_ready, count(*) = 4 AND count(DISTINCT period_end) = 1 AND any_value(nb) IS NOT NULL AS ready
FROM instants LEFT JOIN (SELECT entity, as_of, ttm*0.5 - abs(ttm*0.25) AS nb FROM ttm_rows WHERE metric = 'cfo') b USING (entity, as_of) GROUP BY 1, 2""")
def _(v):
    debt = v.flow_facts.filter("metric = 'cfo'")
    parts = debt.withColumn("tag", F.lit("us-gaap:ProceedsFromIssuanceOfDebt")).withColumn("val", F.col("val") * 0.5).unionByName(
        debt.withColumn("tag", F.lit("us-gaap:RepaymentsOfDebt")).withColumn("val", F.col("val") * -0.25))
    return fu.financing(v.balance_facts.unionByName(parts), fu.filing_days(v.balance_facts))


@view("entity_prices", "SELECT 'N' || symbol AS entity, session_date, close/1000e0 AS close, CASE WHEN session_date < DATE '1998-05-04' AND symbol IN ('2','4') THEN 2e0 ELSE 1e0 END AS split_share_factor FROM asset_prices")
def _eprices(v):
    split = (F.col("session_date") < F.lit("1998-05-04").cast("date")) & F.col("symbol").isin("2", "4")
    return v.asset_prices.select(F.concat(F.lit("N"), "symbol").alias("entity"), "session_date", (F.col("close") / 1000.0).alias("close"), F.when(split, 2.0).otherwise(1.0).alias("split_share_factor"))


_NEAR = """ASOF LEFT JOIN (SELECT entity AS pe_, session_date AS price_date, close, split_share_factor FROM entity_prices) p ON p.pe_ = r.entity AND r.as_of <= p.price_date"""


@view("fcf", f"""
SELECT *, market_value/CASE WHEN fcf > 0 THEN fcf END AS price_to_fcf, 100*fcf/market_value*CASE WHEN fcf > 0 THEN 1 END AS fcf_yield FROM (
SELECT r.entity, r.as_of, price_date, close, (op-inv)*CASE WHEN r.entity IN ('N3','N7') THEN rate ELSE 1 END AS fcf, sc*split_share_factor AS traded_shares, close*sc*split_share_factor AS market_value FROM (
 SELECT r.*, p.* FROM (SELECT t.entity, t.as_of, max(ttm) FILTER (WHERE metric='cfo') AS op, max(abs(ttm)) FILTER (WHERE metric='capex') AS inv, any_value(s.val) AS sc FROM ttm_rows t
   JOIN (SELECT DISTINCT ON (a.entity, a.as_of) a.entity, a.as_of, f.val FROM (SELECT DISTINCT entity, filed AS as_of FROM flow_facts) a JOIN balance_facts f ON f.entity = a.entity AND f.tag = 'shares' AND f.filed <= a.as_of
     ORDER BY a.entity, a.as_of, f."end" DESC, f.filed DESC) s ON s.entity = t.entity AND s.as_of = t.as_of GROUP BY 1, 2) r {_NEAR}) r
ASOF LEFT JOIN (SELECT rate_date, rate FROM fx WHERE currency = 'EUR') x ON r.price_date >= x.rate_date
WHERE op IS NOT NULL AND inv IS NOT NULL AND price_date - r.as_of <= 7 AND (r.entity NOT IN ('N3','N7') OR price_date - rate_date <= 7)) WHERE fcf IS NOT NULL""")
def _fcf(v):
    facts = v.flow_facts.filter(F.col("metric").isin("cfo", "capex")).unionByName(v.balance_facts.filter("metric = 'shares'"))
    return fu.fcf_history(facts, v.entity_prices, v.fx)


@query("fcf_history", "entity:s as_of:d price_date:d fcf:f2 traded_shares:f2 market_value:f2 price_to_fcf:f fcf_yield:f4", "SELECT * FROM fcf")
def _(v):
    return v.fcf


@view("pes", f"""
SELECT *, close/eps AS pe FROM (SELECT r.entity, r.as_of, price_date, close, ttm/split_share_factor AS eps FROM (SELECT * FROM ttm_rows WHERE metric = 'eps') r {_NEAR} WHERE price_date - r.as_of <= 7) WHERE eps > 0 AND close/eps <= 300""")
def _pes(v):
    return fu.pe_history(v.flow_facts, v.entity_prices)


@query("pe_history", "entity:s as_of:d price_date:d eps:f pe:f", "SELECT * FROM pes")
def _(v):
    return v.pes


@query("percentile_rank_mid", "entity:s pe:f observations:l percentile:f verdict:s", """
SELECT *, CASE WHEN percentile IS NULL THEN 'not enough history' WHEN percentile <= 0.25 THEN 'cheaper than usual' WHEN percentile <= 0.75 THEN 'within its own range' ELSE 'more expensive than usual' END AS verdict FROM (
SELECT l.entity, any_value(l.pe) AS pe, count(h.pe) AS observations, CASE WHEN count(h.pe) >= 5 THEN (count(*) FILTER (WHERE h.pe < l.pe) + 0.5*count(*) FILTER (WHERE h.pe = l.pe))/count(h.pe) END AS percentile
FROM (SELECT entity, max(as_of) AS as_of, arg_max(pe, as_of) AS pe FROM pes GROUP BY 1) l LEFT JOIN pes h ON h.entity = l.entity AND h.as_of < l.as_of GROUP BY 1)""")
def _(v):
    return fu.own_range(v.pes, "pe")


@view("annuals", "SELECT entity, year(as_of) AS year, arg_max(fcf/traded_shares, as_of) AS per_share FROM fcf WHERE fcf > 0 AND traded_shares > 0 GROUP BY 1, 2")
def _annuals(v):
    return fu.annual_per_share(v.fcf)


@query("annual_per_share", "entity:s year:l per_share:f", "SELECT * FROM annuals")
def _(v):
    return v.annuals


@view("growths", """
SELECT entity, points, least(8, greatest(0, coalesce(list_median(g[greatest(1, len(g)-4):])*100, 0))) AS base_growth, list_median(ps[greatest(1, len(ps)-2):]) AS recent_median FROM (
 SELECT entity, count(*) AS points, list(g ORDER BY year) FILTER (WHERE g IS NOT NULL) AS g, list(per_share ORDER BY year) AS ps FROM (
  SELECT *, CASE WHEN lag(year) OVER w IS NOT NULL THEN least(0.5, greatest(-0.5, pow(per_share/lag(per_share) OVER w, 1e0/(year-lag(year) OVER w))-1)) END AS g FROM annuals WINDOW w AS (PARTITION BY entity ORDER BY year)) GROUP BY 1)""")
def _growths(v):
    return fu.growth_anchor(v.annuals)


@query("growth_anchor", "entity:s points:l base_growth:f recent_median:f", "SELECT * FROM growths")
def _(v):
    return v.growths


_DCF = "entity, points, price, start*{m} AS start, {g} AS growth, {d} AS discount, {t} AS terminal_growth, '{n}' AS scenario"
_CASES = [("downside", "greatest(-5, least(0, base_growth-6))", "disc+2", "1.5", "0.8"), ("base", "base_growth", "disc", "2", "1"), ("strong", "least(10, base_growth+3)", "greatest(9.5, disc-1)", "2.5", "1")]


@view("dcf", """
SELECT *, points >= 3 AND max(CASE WHEN scenario = 'base' THEN terminal_share END) OVER (PARTITION BY entity) <= 80 AS ready FROM (
SELECT *, tv/(fv+tv)*100 AS terminal_share, fv+tv AS value, ((fv+tv)/price-1)*100 AS versus_price FROM (
SELECT *, start*(s+s*s+pow(s,3)+pow(s,4)+pow(s,5)) AS fv, start*pow(s,5)*(1+terminal_growth/100)/((discount-terminal_growth)/100) AS tv FROM (
SELECT *, (1+growth/100e0)/(1+discount/100e0) AS s FROM (""" + " UNION ALL ".join("SELECT " + _DCF.format(n=n, g=g, d=d, t=t, m=m) + " FROM dcf_in" for n, g, d, t, m in _CASES) + "))))")
def _dcf(v):
    price = v.fcf.groupBy("entity").agg(F.max_by("close", "as_of").alias("price"))
    c = v.growths.join(price, "entity").withColumn("used_beta", 0.8 + F.pmod(F.col("points"), F.lit(9)) / 10.0).withColumn("start_cash", F.col("recent_median"))
    return fu.dcf_scenarios(c)


@view("dcf_in", "SELECT g.entity, g.points, p.price, g.recent_median AS start, g.base_growth, greatest(10.5, 4.5 + (0.8e0 + (g.points % 9)/10e0)*5.5) AS disc FROM growths g JOIN (SELECT entity, arg_max(close, as_of) AS price FROM fcf GROUP BY 1) p ON p.entity = g.entity WHERE recent_median > 0")
def _dcf_in(v):
    return v.growths


@query("dcf_scenarios", "entity:s scenario:s growth:f discount:f terminal_growth:f value:f terminal_share:f versus_price:f ready:b", "SELECT * FROM dcf")
def _(v):
    return v.dcf


@query("dcf_readiness", "companies:l ready:l above_price:l", "SELECT count(*) AS companies, count(*) FILTER (WHERE ready) AS ready, count(*) FILTER (WHERE versus_price > 0) AS above_price FROM dcf WHERE scenario = 'base'")
def _(v):
    return fu.dcf_readiness(v.dcf)


@query("investment_split", "entity:s scenario:s growth_investment:f2 maintenance_investment:f2 owner_cash:f2", """
SELECT entity, s AS scenario, g*k AS growth_investment, cx-g*k AS maintenance_investment, op-cx+g*k AS owner_cash FROM (
 SELECT entity, op, cx, greatest(0, cx-op*0.2e0) AS g FROM (SELECT entity, max(ttm) FILTER (WHERE metric='cfo') AS op, max(abs(ttm)) FILTER (WHERE metric='capex') AS cx FROM ttm_rows t WHERE as_of = (SELECT max(as_of) FROM ttm_rows u WHERE u.entity = t.entity) GROUP BY 1) WHERE op > 0),
 (VALUES ('downside', 0e0), ('base', 0.5e0), ('strong', 1e0)) c(s, k)""")
def _(v):
    last = v.ttm_rows.groupBy("entity").agg(F.max("as_of").alias("as_of"))
    t = v.ttm_rows.join(last, ["entity", "as_of"]).groupBy("entity").agg(
        F.max(F.when(F.col("metric") == "cfo", F.col("ttm"))).alias("operating"), F.max(F.when(F.col("metric") == "capex", F.abs("ttm"))).alias("capex"))
    return fu.investment_split(t.withColumn("depreciation", F.col("operating") * 0.2).withColumn("quality", F.lit("moderate")))


@query("filing_period_select", "entity:s accn:s revenue:f2 prior_revenue:f2 growth:f margin:f growth_check:s margin_check:s", """
SELECT *, CASE WHEN growth IS NULL THEN 'unavailable' WHEN abs(growth-5) <= 15 THEN 'agrees' ELSE 'review' END AS growth_check, CASE WHEN margin IS NULL THEN 'unavailable' WHEN abs(margin-12) <= 8 THEN 'agrees' ELSE 'review' END AS margin_check FROM (
SELECT entity, accn, r AS revenue, pr AS prior_revenue, CASE WHEN pr > 0 THEN (r/pr-1)*100 END AS growth, CASE WHEN r > 0 THEN i/r*100 END AS margin FROM (
 SELECT entity, accn, arg_max(val, "end") FILTER (WHERE metric='revenue') AS r, CASE WHEN count(*) FILTER (WHERE metric='revenue') > 1 THEN arg_min(val, "end") FILTER (WHERE metric='revenue') END AS pr, arg_max(val, "end") FILTER (WHERE metric='income') AS i
 FROM flow_facts WHERE metric IN ('revenue','income') GROUP BY 1, 2))""")
def _(v):
    market = v.flow_facts.select("entity").distinct().withColumn("market_growth", F.lit(5.0)).withColumn("market_margin", F.lit(12.0))
    return fu.filing_check(v.flow_facts, market)


# --- macro -----------------------------------------------------------------------------------------------------------

@view("macro_obs", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'CPIAUCSL' ELSE 'UNRATE' END AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE)*CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0.02 END AS value FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY o_orderstatus, 2
UNION ALL SELECT 'GDPC1', CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL SELECT 'DGS10', session_date, bench_close/1000e0 FROM bench UNION ALL SELECT 'DGS2', session_date, bench_close/900e0 - 0.3e0 FROM bench""")
def _macro_obs(v):
    o = v.table("orders")
    n = F.count(F.lit(1)).cast("double")
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")
    monthly = o.filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus", month).agg(n.alias("n")).select(
        F.when(F.col("o_orderstatus") == "F", "CPIAUCSL").otherwise("UNRATE").alias("series"), "date", (F.col("n") * F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.02)).alias("value"))
    gdp = o.groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date")).agg(n.alias("value")).select(F.lit("GDPC1").alias("series"), "date", "value")
    ten = v.bench.select(F.lit("DGS10").alias("series"), F.col("session_date").alias("date"), (F.col("bench_close") / 1000.0).alias("value"))
    two = v.bench.select(F.lit("DGS2").alias("series"), F.col("session_date").alias("date"), (F.col("bench_close") / 900.0 - 0.3).alias("value"))
    return monthly.unionByName(gdp).unionByName(ten).unionByName(two)


@view("macro_vint", "SELECT DISTINCT series, date + CASE WHEN series LIKE 'DGS%' THEN 1 ELSE 42 END AS vintage FROM macro_obs")
def _macro_vint(v):
    return v.macro_obs.select("series", F.date_add("date", F.when(F.col("series").startswith("DGS"), 1).otherwise(42)).alias("vintage")).distinct()


@view("macro_cut", "SELECT DISTINCT CAST(date_trunc('month', session_date) AS DATE) + 19 AS cutoff FROM bench")
def _macro_cut(v):
    return v.bench.select(F.date_add(F.trunc("session_date", "MM"), 19).alias("cutoff")).distinct()


@view("macro_lagged", """
SELECT o.*, a.value AS lag_3, b.value AS lag_12, c.value AS lag_15 FROM macro_obs o LEFT JOIN macro_obs a ON a.series = o.series AND a.date = CAST(date_trunc('month', o.date) - INTERVAL 3 MONTH AS DATE)
LEFT JOIN macro_obs b ON b.series = o.series AND b.date = CAST(date_trunc('month', o.date) - INTERVAL 12 MONTH AS DATE) LEFT JOIN macro_obs c ON c.series = o.series AND c.date = CAST(date_trunc('month', o.date) - INTERVAL 15 MONTH AS DATE)""")
def _macro_lagged(v):
    return macro.macro_lags(v.macro_obs)


@query("macro_lags", "series:s date:d value:f lag_3:f lag_12:f lag_15:f", "SELECT * FROM macro_lagged")
def _(v):
    return v.macro_lagged


_AGE = "CASE series WHEN 'DGS2' THEN {d} WHEN 'DGS10' THEN {d} WHEN 'GDPC1' THEN {g} ELSE {m} END"


@query("macro_regime", "cutoff:d inflation:f inflation_direction:f unemployment_change:f growth:f curve:f growth_signal:s inflation_signal:s labor_signal:s rates_signal:s missing_series:l stale_series:l ready:b label:s status:s", f"""
WITH x AS (SELECT a.cutoff, a.series, o.date, o.value, o.lag_3, o.lag_12, o.lag_15, v.vintage FROM (SELECT cutoff, unnest(['DGS2','DGS10','CPIAUCSL','UNRATE','GDPC1']) AS series FROM macro_cut) a
 ASOF LEFT JOIN macro_lagged o ON o.series = a.series AND a.cutoff >= o.date ASOF LEFT JOIN macro_vint v ON v.series = a.series AND a.cutoff >= v.vintage),
w AS (SELECT cutoff, max(value) FILTER (WHERE series='CPIAUCSL') AS c0, max(lag_12) FILTER (WHERE series='CPIAUCSL') AS c12, max(lag_3) FILTER (WHERE series='CPIAUCSL') AS c3, max(lag_15) FILTER (WHERE series='CPIAUCSL') AS c15,
 max(value) FILTER (WHERE series='UNRATE') - max(lag_3) FILTER (WHERE series='UNRATE') AS un, (pow(max(value) FILTER (WHERE series='GDPC1')/max(lag_3) FILTER (WHERE series='GDPC1'), 4)-1)*100 AS gr,
 CASE WHEN max(date) FILTER (WHERE series='DGS2') = max(date) FILTER (WHERE series='DGS10') THEN max(value) FILTER (WHERE series='DGS10') - max(value) FILTER (WHERE series='DGS2') END AS cv,
 count(*) FILTER (WHERE date IS NULL OR vintage IS NULL) AS ms, count(*) FILTER (WHERE coalesce(cutoff-vintage > {_AGE.format(d=7, g=120, m=45)}, true) OR coalesce(cutoff-date > {_AGE.format(d=10, g=240, m=75)}, true)) AS st FROM x GROUP BY 1),
s AS (SELECT *, (c0/c12-1)*100 AS inf, (c0/c12-1)*100-(c3/c15-1)*100 AS dir FROM w),
t AS (SELECT *, ms = 0 AND st = 0 AND inf IS NOT NULL AND dir IS NOT NULL AND un IS NOT NULL AND gr IS NOT NULL AND cv IS NOT NULL AS ready, CASE WHEN gr < 0 THEN 'contracting' WHEN gr > 0 THEN 'expanding' ELSE 'unclear' END AS g,
 CASE WHEN inf >= 3 THEN 'elevated' WHEN inf < 1 THEN 'low' WHEN inf IS NOT NULL THEN 'moderate' ELSE 'unclear' END AS i, CASE WHEN un >= 0.3 THEN 'weakening' WHEN un <= -0.3 THEN 'improving' WHEN un IS NOT NULL THEN 'stable' ELSE 'unclear' END AS l,
 CASE WHEN cv < 0 THEN 'inverted' WHEN cv IS NOT NULL THEN 'upward_sloping' ELSE 'unclear' END AS r FROM s)
SELECT cutoff, inf AS inflation, dir AS inflation_direction, un AS unemployment_change, gr AS growth, cv AS curve, g AS growth_signal, i AS inflation_signal, l AS labor_signal, r AS rates_signal, ms AS missing_series, st AS stale_series, ready,
 CASE WHEN NOT ready THEN 'unavailable' WHEN g = 'contracting' AND l = 'weakening' THEN 'downturn_risk' WHEN g = 'expanding' AND i = 'elevated' THEN 'inflationary_expansion' WHEN g = 'expanding' THEN 'expansion' ELSE 'mixed' END AS label,
 CASE WHEN ready THEN 'ready' WHEN ms > 0 THEN 'unavailable' WHEN st > 0 THEN 'stale' ELSE 'partial' END AS status FROM t""")
def _(v):
    return macro.macro_regime(v.macro_obs, v.macro_vint, v.macro_cut)


# --- analysts --------------------------------------------------------------------------------------------------------

_RATES = ["Strong Buy", "Hold", "Underperform", "Market_Perform", "sell", "speculative"]


@view("rating_rows", """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'u' || user_id END AS ticker, CAST(ts AS DATE) AS date, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'F' || event_id % 7 END AS firm, 'A' || event_id % 9 AS analyst,
 CASE event_id % 6 WHEN 0 THEN 'Strong Buy' WHEN 1 THEN 'Hold' WHEN 2 THEN 'Underperform' WHEN 3 THEN 'Market_Perform' WHEN 4 THEN 'sell' ELSE 'speculative' END AS rating,
 CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS target, CAST(value AS VARCHAR) AS target_prior FROM events""")
def _rating_rows(v):
    k, val = F.col("event_id"), F.col("value").cast("string")
    rates = F.array(*[F.lit(r) for r in _RATES])
    return v.table("events").select("event_id", F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("ticker"), F.to_date("ts").alias("date"),
                                    F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("F"), (k % 7).cast("string"))).alias("firm"), F.concat(F.lit("A"), (k % 9).cast("string")).alias("analyst"),
                                    F.get(rates, (k % 6).cast("int")).alias("rating"), F.when(k % 5 == 0, "n/a").otherwise(val).alias("target"), val.alias("target_prior"))


@view("ratings", """
SELECT event_id, upper(trim(ticker)) AS symbol, date, firm, analyst, CASE event_id % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' WHEN 4 THEN 'negative' ELSE 'unknown' END AS direction,
 TRY_CAST(target AS DOUBLE) AS price_target, TRY_CAST(target_prior AS DOUBLE) AS prior_target FROM rating_rows WHERE trim(ticker) <> '' AND firm <> ''""")
def _ratings(v):
    return analysts.analyst_actions(v.rating_rows)


@query("analyst_actions", "event_id:l symbol:s date:d firm:s direction:s price_target:f prior_target:f", "SELECT * FROM ratings")
def _(v):
    return v.ratings


@query("analyst_summary", "symbol:s actions:l firms:l analysts:l positive_share:f score:f difference:f cross_check:s ready:b", """
SELECT *, CASE WHEN difference > 30 THEN 'review' WHEN difference IS NOT NULL THEN 'agrees' ELSE 'unavailable' END AS cross_check, firms >= 3 AND d > 0 AND difference IS NOT NULL AND NOT coalesce(difference > 30, false) AS ready FROM (
SELECT s.*, abs(positive_share - c.share) AS difference FROM (SELECT symbol, count(*) AS actions, count(DISTINCT firm) AS firms, count(DISTINCT analyst) AS analysts, count(*) FILTER (WHERE direction <> 'unknown') AS d,
 count(*) FILTER (WHERE direction='positive')*100e0/nullif(count(*) FILTER (WHERE direction <> 'unknown'), 0) AS positive_share, avg(CASE direction WHEN 'positive' THEN 80 WHEN 'neutral' THEN 50 WHEN 'negative' THEN 20 END) AS score
 FROM ratings WHERE DATE '2024-01-31' - date <= 14 GROUP BY 1) s LEFT JOIN (SELECT DISTINCT 'U' || user_id AS symbol, CAST((user_id*7) % 100 AS DOUBLE) AS share FROM events WHERE user_id % 10 <> 0) c USING (symbol))""")
def _(v):
    e = v.table("events").filter("user_id % 10 <> 0")
    consensus = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), ((F.col("user_id") * 7) % 100).cast("double").alias("consensus_share")).distinct()
    return analysts.analyst_summary(v.ratings, consensus, F.lit("2024-01-31").cast("date"), 14)


@view("estimates", """
SELECT CAST(o_custkey % 200 AS VARCHAR) AS symbol, make_date(year(o_orderdate), 12, 31) AS fiscal_date, CAST(o_orderdate AS DATE) AS captured, max(o_totalprice)/1000e0 - 100e0 AS eps, CASE WHEN max(o_orderkey) % 5 = 0 THEN NULL ELSE min(o_totalprice) END AS revenue FROM orders GROUP BY 1, 2, 3""")
def _estimates(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").groupBy((F.col("o_custkey") % 200).cast("string").alias("symbol"), F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("fiscal_date"), d.alias("captured")).agg(
        (F.max("o_totalprice") / 1000.0 - 100.0).alias("eps"), F.when(F.max("o_orderkey") % 5 == 0, F.lit(None).cast("double")).otherwise(F.min("o_totalprice")).alias("revenue"))


@query("estimate_revision", "symbol:s fiscal_date:d captured:d status:s eps_change:f4 revenue_change:f4 direction:s", """
SELECT *, CASE WHEN prior IS NULL THEN 'baseline' ELSE 'compared' END AS status, CASE WHEN prior IS NULL THEN NULL WHEN m >= 1 THEN 'up' WHEN m <= -1 THEN 'down' ELSE 'unchanged' END AS direction FROM (
SELECT *, (coalesce(eps_change,0)+coalesce(revenue_change,0))/nullif((CASE WHEN eps_change IS NOT NULL THEN 1 ELSE 0 END)+(CASE WHEN revenue_change IS NOT NULL THEN 1 ELSE 0 END),0) AS m FROM (
SELECT *, lag(captured) OVER w AS prior, (eps-lag(eps) OVER w)/abs(nullif(lag(eps) OVER w,0))*100 AS eps_change, (revenue-lag(revenue) OVER w)/abs(nullif(lag(revenue) OVER w,0))*100 AS revenue_change FROM estimates WINDOW w AS (PARTITION BY symbol, fiscal_date ORDER BY captured)))""")
def _(v):
    return analysts.estimate_revision(v.estimates)


@query("nearest_estimate", "symbol:s fiscal_date:d captured:d eps:f", """
SELECT DISTINCT ON (symbol) symbol, fiscal_date, captured, eps FROM estimates WHERE fiscal_date >= DATE '1999-02-10' - 45 ORDER BY symbol, fiscal_date, captured""")
def _(v):
    return analysts.nearest_estimate(v.estimates, F.lit("1999-02-10").cast("date"))


@query("earnings_surprise", "symbol:s reports:l mean_surprise:f beats:l", """
SELECT symbol, count(*) AS reports, avg(s) AS mean_surprise, count(*) FILTER (WHERE s > 0) AS beats FROM (
 SELECT symbol, s, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, k DESC) AS rn FROM (SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS d, o_orderkey AS k, least(30, greatest(-30, (o_totalprice - (o_totalprice+100000)/2)/abs((o_totalprice+100000)/2)*100)) AS s FROM orders)) WHERE rn <= 4 GROUP BY 1""")
def _(v):
    r = v.table("orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("reported_on"), F.col("o_orderkey").alias("report_id"),
                                 F.col("o_totalprice").alias("actual"), ((F.col("o_totalprice") + 100000) / 2).alias("expected"))
    return analysts.earnings_surprise(r)
