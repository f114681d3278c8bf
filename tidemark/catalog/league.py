"""Queries over disclosed holdings, cross-sectional scores and company assessment."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import league, managers as mg


@view("named_holdings", """
SELECT h.*, CASE CAST(cusip AS BIGINT) % 4 WHEN 0 THEN 'Maker ' || CAST(cusip AS BIGINT)//8 || ', Inc.' WHEN 1 THEN 'MAKER ' || CAST(cusip AS BIGINT)//8 || ' Corp Co' ELSE 'Firm ' || cusip || ' Ltd' END AS issuer FROM holdings h""")
def _named(v):
    k = F.col("cusip").cast("bigint")
    half = F.floor(k / 8).cast("string")
    return v.holdings.withColumn("issuer", F.when(k % 4 == 0, F.concat(F.lit("Maker "), half, F.lit(", Inc."))).when(k % 4 == 1, F.concat(F.lit("MAKER "), half, F.lit(" Corp Co")))
                                 .otherwise(F.concat(F.lit("Firm "), "cusip", F.lit(" Ltd"))))


@query("consolidate_holdings", "manager:s period:l cusip:s shares:f2 value:f2 issuer:s", """
SELECT manager, period, cusip, sum(shares)*2 AS shares, sum(value)*2 AS value, min(issuer) AS issuer FROM named_holdings GROUP BY 1, 2, 3""")
def _(v):
    return mg.consolidate(v.named_holdings.unionByName(v.named_holdings))


@view("mpos", """
SELECT *, value/sum(value) OVER (PARTITION BY manager)*100 AS weight FROM (
SELECT h.*, p.shares AS prior_shares, CASE WHEN p.shares IS NULL OR p.shares <= 0 THEN 'New' WHEN (h.shares-p.shares)/p.shares*100 >= 10 THEN 'Increased' WHEN (h.shares-p.shares)/p.shares*100 <= -10 THEN 'Reduced' ELSE 'Held' END AS action
FROM named_holdings h JOIN (SELECT manager, max(period) AS period FROM holdings GROUP BY 1) m ON m.manager = h.manager AND m.period = h.period
LEFT JOIN holdings p ON p.manager = h.manager AND p.cusip = h.cusip AND p.period = h.period - 1)""")
def _mpos(v):
    return mg.manager_positions(v.named_holdings)


@query("manager_ideas", "cusip:s issuer:s owners:l active_buyers:l highest_conviction:f", """
SELECT cusip, min(issuer) AS issuer, count(*) AS owners, count(*) FILTER (WHERE action IN ('New','Increased')) AS active_buyers, max(weight) AS highest_conviction FROM mpos GROUP BY 1""")
def _(v):
    return mg.manager_ideas(v.mpos)


@query("ranked_managers", "cusip:s manager:s rank:l action:s weight:f", """
SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY CASE WHEN action IN ('New','Increased') THEN 0 ELSE 1 END, weight DESC, manager) AS rank FROM mpos""")
def _(v):
    return mg.ranked_managers(v.mpos)


_KEY = r"nullif(regexp_replace(trim(regexp_replace(upper(issuer), '[^A-Z0-9]+', ' ', 'g')), '(^| )(INC|CORP|CORPORATION|PLC|LTD|LIMITED|CO|COMPANY)( (INC|CORP|CORPORATION|PLC|LTD|LIMITED|CO|COMPANY))*$', ''), '')"


@view("companies", f"""
WITH p AS (SELECT *, coalesce({_KEY}, cusip) AS company FROM mpos), m AS (SELECT company, manager, sum(weight) AS weight, arg_max(action, CASE action WHEN 'New' THEN 4 WHEN 'Increased' THEN 3 WHEN 'Held' THEN 2 ELSE 1 END) AS action FROM p GROUP BY 1, 2),
c AS (SELECT company, cusip, count(*) AS o, count(*) FILTER (WHERE action IN ('New','Increased')) AS a, max(weight) AS c, min(issuer) AS issuer FROM p GROUP BY 1, 2)
SELECT * FROM (SELECT company, count(*) AS owners, count(*) FILTER (WHERE action IN ('New','Increased')) AS active_buyers, max(weight) AS highest_conviction FROM m GROUP BY 1)
JOIN (SELECT company, arg_max(cusip, (o, a, c, cusip)) AS primary_cusip, arg_max(issuer, (o, a, c, cusip)) AS issuer, count(*) AS share_classes FROM c GROUP BY 1) USING (company)""")
def _companies(v):
    return mg.dedupe_companies(v.mpos)


@query("dedupe_companies", "company:s primary_cusip:s issuer:s share_classes:l owners:l active_buyers:l highest_conviction:f", "SELECT * FROM companies")
def _(v):
    return v.companies


@query("holding_conviction", "company:s owners:l active_buyers:l highest_conviction:f", "SELECT * FROM companies ORDER BY active_buyers DESC, owners DESC, highest_conviction DESC, issuer, company LIMIT 12")
def _(v):
    return mg.holding_conviction(v.named_holdings)


@query("resolve_identity", "instrument:s candidates:l status:s figi:s", """
SELECT CAST(o_custkey AS VARCHAR) AS instrument, count(*) AS candidates, CASE count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
 CASE WHEN count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) = 1 THEN max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) END AS figi FROM orders GROUP BY 1""")
def _(v):
    c = v.table("orders").select(F.col("o_custkey").cast("string").alias("instrument"), F.col("o_orderpriority").alias("figi"), (F.col("o_orderstatus") == "P").alias("eligible"))
    return mg.resolve_identity(c)


# --- companies with metrics: one per part ----------------------------------------------------------------------------

_SECTORS = ["Semiconductors", "Software", "Technology", "Financial services", "Healthcare", "Energy", "default"]
_METRICS = {  # modulus and shift that spread a part's numbers over the range of the metric; every 7th..13th is missing
    "price_to_book": (97, 10, -1.0, 7), "forward_pe": (89, 2, -4.0, 11), "roe": (83, 2, -5.0, 13), "margin": (79, 2, -4.0, 9), "debt_to_equity": (61, 30, 0.0, 8), "six_month_return": (71, 1, -30.0, 12),
    "year_return": (103, 1, -40.0, 10), "return_volatility": (43, 1, 0.0, 17), "analyst_positive": (101, 1, 0.0, 19), "analyst_change": (31, 1, -15.0, 6), "surprise": (59, 1, -29.0, 5),
    "revenue_growth": (67, 1, -25.0, 14), "earnings_growth": (73, 1, -30.0, 15), "pe": (53, 1, 1.0, 16), "peg": (47, 10, 0.1, 18), "eps": (41, 4, -1.0, 21), "price_to_cash_flow": (37, 1, 1.0, 23),
    "ev_to_ebitda": (29, 1, 1.0, 24), "ev_to_revenue": (27, 2, 0.5, 25), "year_position": (102, 1, 0.0, 26), "analyst_score": (99, 1, 0.0, 27), "surprise_score": (98, 1, 0.0, 28)}
_METSQL = ", ".join(f"CASE WHEN (p_partkey+{i}) % {miss} <> 0 THEN CAST((p_partkey*{7919 + 2 * i}) % {mod} AS DOUBLE)/{div}e0 + ({shift}) END AS {n}" for i, (n, (mod, div, shift, miss)) in enumerate(_METRICS.items()))


@view("metrics", f"""
SELECT CAST(p_partkey AS VARCHAR) AS symbol, list_extract({_SECTORS!r}, CAST(p_partkey % 7 + 1 AS BIGINT)) AS sector, p_retailprice/20e0 AS price, {_METSQL}, p_partkey % 9 AS analyst_count, CASE p_partkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS revision,
 CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 6 + 1 END AS owners, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 END AS active_buyers, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 17 AS DOUBLE) END AS conviction,
 p_partkey % 10 <> 0 AS identity_resolved, p_partkey % 12 = 0 AS filing_conflict, p_partkey % 2 = 0 AS filing_agrees FROM part""")
def _metrics(v):
    k = F.col("p_partkey")
    cols = [F.when((k + i) % miss != 0, ((k * (7919 + 2 * i)) % mod).cast("double") / float(div) + shift).alias(n) for i, (n, (mod, div, shift, miss)) in enumerate(_METRICS.items())]
    idea = k % 4 == 0
    return v.table("part").select(
        k.cast("string").alias("symbol"), F.get(F.array(*[F.lit(s) for s in _SECTORS]), (k % 7).cast("int")).alias("sector"), (F.col("p_retailprice") / 20.0).alias("price"), *cols, (k % 9).alias("analyst_count"),
        F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").alias("revision"), F.when(idea, k % 6 + 1).alias("owners"), F.when(idea, k % 3).alias("active_buyers"), F.when(idea, (k % 17).cast("double")).alias("conviction"),
        (k % 10 != 0).alias("identity_resolved"), (k % 12 == 0).alias("filing_conflict"), (k % 2 == 0).alias("filing_agrees"))


def _z(x, sector=False):
    g = f"CASE WHEN coalesce(stddev_pop({x}) OVER (), 0) > 0 THEN ({x} - avg({x}) OVER ())/stddev_pop({x}) OVER () ELSE 0 END"
    if sector:
        p = "OVER (PARTITION BY sector)"
        g = f"CASE WHEN count({x}) {p} >= 4 THEN CASE WHEN stddev_pop({x}) {p} > 0 THEN ({x} - avg({x}) {p})/stddev_pop({x}) {p} ELSE 0 END ELSE {g} END"
    return f"CASE WHEN {x} IS NOT NULL THEN least(3e0, greatest(-3e0, {g})) END"


def _wa(parts):
    num = "+".join(f"coalesce({v}*({w}),0)" for v, w in parts)
    den = "+".join(f"CASE WHEN {v} IS NOT NULL THEN {abs(w)}e0 ELSE 0e0 END" for v, w in parts)
    return f"({num})/nullif({den},0)"


@query("zscores", "symbol:s z_roe:f z_margin_sector:f", f"SELECT symbol, {_z('roe')} AS z_roe, {_z('margin', True)} AS z_margin_sector FROM metrics")
def _(v):
    d = league.zscores(v.metrics, {"z_roe": F.col("roe")})
    return league.zscores(d, {"z_margin_sector": F.col("margin")}, "sector")


@query("percentile_scores", "symbol:s roe_percentile:f", "SELECT m.symbol, r.p AS roe_percentile FROM metrics m LEFT JOIN (SELECT symbol, (row_number() OVER (ORDER BY roe, symbol)-1)*100e0/(count(*) OVER ()-1) AS p FROM metrics WHERE roe IS NOT NULL) r USING (symbol)")
def _(v):
    return league.percentile_scores(v.metrics, "roe", "symbol", "roe_percentile")


_L1 = {"z_book": "CASE WHEN price_to_book > 0 THEN 1/price_to_book END", "z_earn": "CASE WHEN forward_pe > 0 THEN 1/forward_pe END", "z_roe": "roe", "z_margin": "margin", "z_debt": "debt_to_equity",
       "z_half": "six_month_return/CASE WHEN return_volatility > 0 THEN return_volatility END", "z_year": "year_return/CASE WHEN return_volatility > 0 THEN return_volatility END",
       "z_breadth": "CASE WHEN analyst_count >= 3 THEN analyst_positive END", "z_change": "analyst_change", "z_revision": "CASE revision WHEN 'up' THEN 1e0 WHEN 'down' THEN -1e0 END", "z_surprise": "surprise"}


@view("leagued", f"""
WITH a AS (SELECT *, {", ".join(f"{e} AS x_{n}" for n, e in _L1.items())} FROM metrics), b AS (SELECT *, {", ".join(f"{_z('x_' + n)} AS {n}" for n in _L1)} FROM a),
c AS (SELECT *, {_wa([("z_book", 0.33), ("z_earn", 0.67)])} AS v0, {_wa([("z_roe", 1), ("z_margin", 1)])} AS pr, {_wa([("z_half", 1), ("z_year", 1)])} AS p0, {_wa([("z_breadth", 1), ("z_change", 1), ("z_revision", 1), ("z_surprise", 1)])} AS s0 FROM b),
d AS (SELECT *, {_wa([("pr", 0.25), ("z_debt", -0.125)])} AS q0 FROM c), e AS (SELECT *, {_z('v0', True)} AS vf, {_z('q0', True)} AS qf, {_z('p0')} AS pm, {_z('s0')} AS sf FROM d),
f AS (SELECT *, {_wa([("pm", 1), ("sf", 1)])} AS m0 FROM e), g AS (SELECT *, {_z('m0')} AS mf FROM f), h AS (SELECT *, coalesce(mf,0)*0.3334e0 + coalesce(vf,0)*0.3333e0 + coalesce(qf,0)*0.3333e0 AS alpha FROM g),
i AS (SELECT h.*, ic FROM h LEFT JOIN (SELECT symbol, floor(55 + (count(*) OVER () - (row_number() OVER (ORDER BY active_buyers DESC, owners DESC, conviction DESC, symbol) - 1) - 1)*45e0/(count(*) OVER () - 1) + 0.5) AS ic FROM h WHERE owners IS NOT NULL) USING (symbol))
SELECT symbol, alpha, vf AS value_factor, qf AS quality_factor, mf AS momentum_factor, sf AS sentiment, ic AS investor_conviction FROM i""")
def _leagued(v):
    return league.research_league(v.metrics)


@query("research_league", "symbol:s alpha:f value_factor:f quality_factor:f momentum_factor:f sentiment:f investor_conviction:l", "SELECT * FROM leagued")
def _(v):
    return v.leagued


def _st(x, steps, floor):
    return "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {t} THEN {s}e0" for t, s in steps) + f" ELSE {floor}e0 END"


def _ms(x, cheap, fair):
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN NULL WHEN {x} <= ({cheap})*0.8 THEN 95e0 WHEN {x} <= {cheap} THEN 86e0 WHEN {x} <= ({cheap}+{fair})/2e0 THEN 72e0 WHEN {x} <= {fair} THEN 55e0 WHEN {x} <= ({fair})*1.25 THEN 35e0 ELSE 15e0 END"


_one = lambda *xs: _wa([(x, 1) for x in xs])
_BAND = lambda i: "CASE sector " + " ".join(f"WHEN '{k}' THEN {b[i]}" for k, b in league.VALUATION_BANDS.items()) + f" ELSE {league.DEFAULT_BANDS[i]} END"
_PF = "CASE WHEN fv IS NULL OR fv <= 0 THEN NULL WHEN price/fv <= 0.72 THEN 96e0 WHEN price/fv <= 0.86 THEN 86e0 WHEN price/fv <= 1 THEN 72e0 WHEN price/fv <= 1.15 THEN 52e0 WHEN price/fv <= 1.35 THEN 30e0 ELSE 12e0 END"
_DEBT = "CASE WHEN debt_to_equity IS NULL THEN NULL WHEN debt_to_equity <= 0.35 THEN 95e0 WHEN debt_to_equity <= 0.8 THEN 75e0 WHEN debt_to_equity <= 1.5 THEN 50e0 ELSE 20e0 END"


@view("assessed", f"""
WITH a AS (SELECT *, {_BAND(0)} AS ch, {_BAND(1)} AS fa, {_one('revenue_growth', 'earnings_growth')} AS g0 FROM metrics),
b AS (SELECT *, least(1.22e0, greatest(0.82e0, 1 + (least(30e0, greatest(-10e0, coalesce(nullif(g0, 0), 8))) - 8)/100)) AS adj FROM a),
c AS (SELECT *, CASE WHEN eps > 0 THEN list_sort([eps*ch*0.9e0, eps*(ch+fa)/2e0*adj, eps*fa*adj])[2] END AS fv FROM b),
c2 AS (SELECT *, {_PF} AS s1, {_ms('forward_pe', 'ch', 'fa')} AS s2, {_ms('price_to_cash_flow', '18', "CASE WHEN eps > 0 AND sector = 'Software' THEN 35 ELSE 30 END")} AS s3, {_ms('ev_to_ebitda', '12', '24')} AS s4, {_ms('ev_to_revenue', '3', '8')} AS s5,
 {_st('roe', league.ROE, 10)} AS q1, {_st('margin', league.MARGIN, 10)} AS q2, {_DEBT} AS q3, {_st('revenue_growth', league.REVENUE, 10)} AS d1, {_st('earnings_growth', league.EARNINGS, 8)} AS d2, {_st('year_return', league.YEAR_RETURN, 20)} AS m1, {_st('year_position', league.YEAR_POSITION, 25)} AS m2 FROM c),
d AS (SELECT *, CASE WHEN eps > 0 THEN {_one('s1', 's2', 's3', 's4')} ELSE {_one('s2', 's3', 's4', 's5')} END AS v0, {_one('q1', 'q2', 'q3')} AS quality, {_one('analyst_score', 'surprise_score')} AS analyst, {_one('m1', 'm2')} AS momentum FROM c2),
e AS (SELECT *, CASE WHEN v0 IS NOT NULL THEN least(100e0, greatest(0e0, v0 + CASE WHEN peg > 0 THEN CASE WHEN peg <= 1 THEN 7 WHEN peg <= 1.8 THEN 2 WHEN peg > 3 THEN -7 ELSE 0 END ELSE 0 END)) END AS valuation,
 CASE WHEN analyst IS NOT NULL THEN least(100e0, greatest(0e0, analyst + coalesce(analyst_change, 0) + CASE revision WHEN 'up' THEN 7 WHEN 'down' THEN -9 ELSE 0 END)) END AS d3 FROM d),
f AS (SELECT *, {_one('d1', 'd2', 'd3')} AS direction FROM e), g AS (SELECT *, {_wa([("quality", 30), ("valuation", 25), ("direction", 20), ("analyst", 15), ("momentum", 10)])} AS score,
 CASE WHEN NOT identity_resolved OR filing_conflict THEN 'Low' WHEN {"+".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in ("pe", "roe", "margin", "revenue_growth", "earnings_growth", "analyst_score", "year_position"))} >= 5 AND analyst_count >= 5
  THEN CASE WHEN filing_agrees THEN 'High' ELSE 'Medium' END ELSE 'Low' END AS confidence FROM f)
SELECT symbol, quality, valuation, direction, analyst, momentum, score, confidence, fv AS fair_value, CASE WHEN (coalesce(revenue_growth < -12 AND earnings_growth < -18, false) OR coalesce(quality < 38 AND direction < 38 AND coalesce(analyst < 45, true), false)) AND score < 43 THEN 'Sell'
 WHEN confidence = 'Medium' AND score >= 68 AND valuation >= 48 AND direction >= 58 THEN 'Buy' WHEN confidence = 'High' AND score >= 68 AND valuation >= 48 AND direction >= 58
  THEN CASE WHEN coalesce(score >= 86 AND quality >= 78 AND valuation >= 70 AND direction >= 72 AND analyst >= 70, false) THEN 'Ultra Buy' ELSE 'Buy' END ELSE 'Hold' END AS action FROM g""")
def _assessed(v):
    return league.assess_company(v.metrics)


@query("assess_company", "symbol:s quality:f valuation:f direction:f analyst:f momentum:f score:f confidence:s fair_value:f action:s", "SELECT * FROM assessed")
def _(v):
    return v.assessed


@view("owned", """
SELECT portfolio, a.symbol, value/sum(value) OVER (PARTITION BY portfolio)*100 AS weight, a.score, a.confidence, a.action, p.sector, (CAST(a.symbol AS BIGINT) % 100)/100e0 AS average_correlation, CAST(CAST(a.symbol AS BIGINT) % 40 AS DOUBLE) AS risk_contribution,
 CASE CAST(a.symbol AS BIGINT) % 9 WHEN 0 THEN 'fund' WHEN 4 THEN 'crypto' ELSE 'stock' END AS instrument FROM positions p JOIN assessed a USING (symbol)""")
def _owned(v):
    j = v.positions.join(v.assessed.select("symbol", "score", "confidence", "action"), "symbol")
    t = j.groupBy("portfolio").agg(F.sum("value").alias("t"))
    k = F.col("symbol").cast("bigint")
    return j.join(t, "portfolio").select("portfolio", "symbol", (F.col("value") / F.col("t") * 100).alias("weight"), "score", "confidence", "action", "sector", ((k % 100) / 100.0).alias("average_correlation"),
                                         (k % 40).cast("double").alias("risk_contribution"), F.when(k % 9 == 0, league.FUND).when(k % 9 == 4, league.CRYPTO).otherwise("stock").alias("instrument"))


@query("weight_review", "portfolio:s symbol:s weight:f neutral:f review:s", """
SELECT *, CASE WHEN score IS NULL OR neutral IS NULL OR instrument <> 'stock' THEN 'separate' WHEN weight > neutral*2 OR (weight > neutral*1.5 AND (coalesce(score < 55, false) OR confidence = 'Low' OR average_correlation >= 0.75 OR risk_contribution > weight*1.5)) THEN 'over'
 WHEN weight < neutral*0.5 AND score >= 70 AND confidence <> 'Low' AND average_correlation < 0.75 THEN 'under' ELSE 'balanced' END AS review FROM (SELECT *, avg(weight) FILTER (WHERE weight > 0 AND instrument = 'stock') OVER (PARTITION BY portfolio) AS neutral FROM owned)""")
def _(v):
    return league.weight_review(v.owned)


@query("compare_opportunity", "portfolio:s symbol:s advantage:f kind:s weakest:s", """
SELECT i.portfolio, i.symbol, i.score - w.x.score AS advantage, w.x.symbol AS weakest, CASE WHEN i.score - w.x.score >= 8 THEN 'replacement' WHEN coalesce(c.sw, 0) < 8 THEN 'diversification' ELSE 'watch' END AS kind
FROM (SELECT 'P' || o_custkey AS portfolio, a.symbol, a.score, m.sector FROM orders JOIN assessed a ON a.symbol = CAST(o_orderkey AS VARCHAR) JOIN metrics m ON m.symbol = a.symbol) i
LEFT JOIN (SELECT portfolio, arg_min({'symbol': symbol, 'score': score}, (CASE action WHEN 'Sell' THEN 0 WHEN 'Hold' THEN 1 WHEN 'Buy' THEN 2 ELSE 3 END, coalesce(score, 50), symbol)) AS x FROM owned WHERE weight > 0 AND instrument <> 'fund' GROUP BY 1) w ON w.portfolio = i.portfolio
LEFT JOIN (SELECT portfolio, sector, sum(weight) AS sw FROM owned GROUP BY 1, 2) c ON c.portfolio = i.portfolio AND c.sector = i.sector""")
def _(v):
    ideas = (v.table("orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("portfolio"), F.col("o_orderkey").cast("string").alias("symbol"))
             .join(v.assessed.select("symbol", "score"), "symbol").join(v.metrics.select("symbol", "sector"), "symbol"))
    return league.compare_opportunity(ideas, v.owned)
