"""Queries over screens, set operations, top-k and appends."""

from pyspark.sql import functions as F

from tidemark import policy
from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import screens, sets

KEY = "ticker:s session_date:d "
STAGES = ["rumour", "filed", "approved", "closed"]


@view("screen_rows", """
SELECT b.ticker, b.session_date, r.exchange AS exchange_mic,
  CASE r.raw_type WHEN 'CS' THEN 'common_stock' WHEN 'ADRC' THEN 'adr' WHEN 'ETF' THEN 'etf' END AS security_type, r.active,
  r.composite_figi IS NOT NULL OR r.cik IS NOT NULL AS identity_clean, b.clean AS corporate_actions_clean, r.currency, b.close,
  CASE WHEN b.trades > 1 THEN b.close*b.volume*1e4 WHEN day(b.session_date) % 5 = 0 THEN NULL WHEN day(b.session_date) % 5 = 1 THEN CAST('nan' AS DOUBLE) ELSE 2e8 END AS market_cap,
  b.close*b.volume AS median_dollar_volume_20d, b.idx AS prior_sessions
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session_date)-1 AS idx FROM bars) b
ASOF LEFT JOIN refs r ON b.ticker = r.ticker AND b.session_date >= r.snapshot_date""")
def _rows(v):
    from tidemark.operators import frames, joins
    b = frames.prior_sessions(v.bars)
    j = joins.asof_join(b, v.refs, "ticker", "session_date", "snapshot_date",
                        ["active", "raw_type", "exchange", "currency", "composite_figi", "cik"])
    day, t = F.day("session_date") % 5, F.col("raw_type")
    return j.select(
        "ticker", "session_date", F.col("exchange").alias("exchange_mic"),
        F.when(t == "CS", "common_stock").when(t == "ADRC", "adr").when(t == "ETF", "etf").alias("security_type"), "active",
        (F.col("composite_figi").isNotNull() | F.col("cik").isNotNull()).alias("identity_clean"),
        F.col("clean").alias("corporate_actions_clean"), "currency", "close",
        F.when(F.col("trades") > 1, F.col("close") * F.col("volume") * 1e4).when(day == 0, F.lit(None).cast("double"))
        .when(day == 1, F.lit(float("nan"))).otherwise(F.lit(2e8)).alias("market_cap"),
        (F.col("close") * F.col("volume")).alias("median_dollar_volume_20d"), "prior_sessions")


_REQ = list(screens.REQUIRED)


def _list(pairs):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


_MISSING = _list([(f"{c} IS NULL", f"missing {c}") for c in _REQ])
_INVALID = _list([("isnan(market_cap)", "invalid market_cap")])
_FAILED = _list([("exchange_mic NOT IN ('XNYS','XNAS','ARCX','BATS')", "venue"), ("security_type NOT IN ('common_stock','adr')", "type"),
                 ("NOT active", "inactive"), ("NOT identity_clean", "identity"), ("NOT corporate_actions_clean", "corporate actions"),
                 ("currency <> 'USD'", "currency"), ("close < 2", "price"), ("market_cap < 3e8", "market value"),
                 ("median_dollar_volume_20d < 30000", "dollar volume"), ("prior_sessions < 126", "history")])


@query("investability", KEY + "eligibility:s why:s", f"""
SELECT ticker, session_date, CASE WHEN len(m)>0 OR len(i)>0 THEN 'unknown' WHEN len(f)=0 THEN 'eligible' ELSE 'ineligible' END AS eligibility,
  array_to_string(CASE WHEN len(m)>0 THEN m WHEN len(i)>0 THEN i ELSE f END, ';') AS why
FROM (SELECT *, {_MISSING} AS m, {_INVALID} AS i, {_FAILED} AS f FROM screen_rows)""")
def _(v):
    return screens.investability(v.screen_rows, min_volume=30000.0).withColumn("why", F.array_join("reasons", ";"))


_RE = _list([("close < 2", "price"), ("dollar_volume IS NULL", "dollar volume missing"), ("dollar_volume < 30000", "dollar volume"),
             ("idx < 126", "history"), ("NOT clean", "corporate actions")])


@query("research_eligible", KEY + "eligible:b why:s", f"""
SELECT ticker, session_date, len(r)=0 AS eligible, array_to_string(r, ';') AS why FROM (SELECT *, {_RE} AS r FROM hist)""")
def _(v):
    return screens.research_eligible(v.hist, min_volume=30000.0).withColumn("why", F.array_join("reasons", ";"))


@query("availability_filter", "ticker:s accession:l event_type:s available_at:t", """
SELECT * FROM iev WHERE published_at <= TIMESTAMP '1998-06-30 20:15:00' AND available_at <= TIMESTAMP '1998-06-30 20:15:00'""")
def _(v):
    return screens.visible_at(v.iev.withColumn("cutoff", F.lit("1998-06-30 20:15:00").cast("timestamp")), "cutoff")


@view("raw_bars", """
SELECT *, CASE WHEN trades = 2 THEN high*0.9e0 WHEN trades = 3 THEN low - 1 ELSE high END AS h2, CASE WHEN day(session_date)=13 THEN -1e0 ELSE volume END AS v2,
  day(session_date) <> 29 AS adjusted FROM bars""")
def _raw(v):
    t, d = F.col("trades"), F.day("session_date")
    return v.bars.withColumns({"h2": F.when(t == 2, F.col("high") * 0.9).when(t == 3, F.col("low") - 1).otherwise(F.col("high")),
                               "v2": F.when(d == 13, -1.0).otherwise(F.col("volume")), "adjusted": d != 29})


def _with_raw(v):
    return (v.raw_bars.drop("high", "volume").withColumnsRenamed({"h2": "high", "v2": "volume"}))


@query("bad_bars", KEY + "close:f high:f low:f volume:f", """
SELECT ticker, session_date, close, h2 AS high, low, v2 AS volume FROM raw_bars WHERE close IS NULL OR close <= 0 OR h2 < low OR v2 < 0 OR NOT adjusted""")
def _(v):
    return screens.bad_bars(_with_raw(v))


@view("field_rows", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' usd' WHEN 1 THEN 'EURO' WHEN 2 THEN 'gbp' ELSE event_type END AS cur,
  CASE WHEN event_id % 3 = 0 THEN sha256(props) ELSE props END AS dig,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END AS inst, value, event_type FROM events""")
def _fields(v):
    k = F.col("event_id")
    zone = F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise("")
    return v.table("events").select(
        "event_id", F.when(k % 4 == 0, " usd").when(k % 4 == 1, "EURO").when(k % 4 == 2, "gbp").otherwise(F.col("event_type")).alias("cur"),
        F.when(k % 3 == 0, F.sha2("props", 256)).otherwise(F.col("props")).alias("dig"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("inst"), "value", "event_type")


@query("currency_hash_utc_clean", "event_id:l currency_clean:s is_hash:b utc_clean:t", """
SELECT event_id, CASE WHEN regexp_full_match(upper(trim(cur)), '[A-Z]{3}') THEN upper(trim(cur)) END AS currency_clean,
  regexp_full_match(dig, '[0-9a-f]{64}') AS is_hash,
  CASE event_id % 3 WHEN 0 THEN CAST(replace(inst, 'Z', '') AS TIMESTAMP) WHEN 1 THEN CAST(replace(inst, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR END AS utc_clean
FROM field_rows""")
def _(v):
    return screens.clean_text_fields(v.field_rows, "cur", "dig", "inst")


@query("finite_or_null", "event_id:l fin:f pos:f nonneg:f", """
SELECT event_id, x AS fin, CASE WHEN x > 0 THEN x END AS pos, CASE WHEN x >= 0 THEN x END AS nonneg FROM (
  SELECT event_id, CASE WHEN isfinite(y) THEN y END AS x FROM (SELECT event_id, TRY_CAST(CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'abc' WHEN 2 THEN 'Infinity'
    WHEN 3 THEN CAST(-value AS VARCHAR) WHEN 4 THEN '0' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS y FROM events))""")
def _(v):
    from tidemark.functions import finite, non_negative, positive
    k, val = F.col("event_id") % 6, F.col("value")
    t = (F.when(k == 0, "NaN").when(k == 1, "abc").when(k == 2, "Infinity").when(k == 3, (-val).cast("string"))
         .when(k == 4, "0").otherwise(val.cast("string")))
    return v.table("events").withColumn("t", t).select("event_id", finite("t").alias("fin"), positive("t").alias("pos"),
                                                       non_negative("t").alias("nonneg"))


@query("position_clean", "symbol:s quantity:f supported:b", """
SELECT upper(trim(p_brand)) AS symbol, round(p_retailprice - 920, 6) AS quantity, upper(trim(p_brand)) IN (SELECT upper(p_brand) FROM part WHERE p_size < 2) AS supported
FROM part WHERE p_retailprice - 920 >= 0""")
def _(v):
    p = v.table("part")
    return screens.clean_positions(p.select(F.col("p_brand").alias("symbol"), (F.col("p_retailprice") - 920).alias("quantity")),
                                   p.filter("p_size < 2").select(F.upper("p_brand").alias("symbol")))


@query("probability_guard", "l_orderkey:l entries:l valid:b", """
SELECT l_orderkey, count(*) AS entries, bool_and(pr >= 0 AND pr <= 1 AND l_linenumber <= 6) AS valid
FROM (SELECT *, l_discount*10e0 + l_tax*2e0 AS pr FROM lineitem) GROUP BY 1""")
def _(v):
    li = v.table("lineitem").select("l_orderkey", (F.col("l_discount") * 10.0 + F.col("l_tax") * 2.0).alias("p"),
                                    F.col("l_linenumber").alias("passed"), F.lit(6).alias("total"))
    return screens.validate_list(li, "l_orderkey")


@view("timeline", """
SELECT user_id AS case_id, event_id AS item, ts AS published_at, CASE least(3, CAST(floor((event_id*1e0/(SELECT max(event_id)+1 FROM events))*4 + CASE WHEN user_id % 3 = 0 AND event_id % 7 = 0 THEN -1 ELSE 0 END) AS INTEGER))
  WHEN 0 THEN 'rumour' WHEN 1 THEN 'filed' WHEN 2 THEN 'approved' WHEN 3 THEN 'closed' ELSE 'rumour' END AS stage,
  value > 5 AS verified, CASE WHEN user_id % 11 = 0 AND value < 10 THEN 'http://x' ELSE 'https://x' END AS url,
  CASE WHEN user_id % 5 = 0 THEN 'approved' ELSE 'closed' END AS declared_stage FROM events""")
def _timeline(v):
    e = v.table("events")
    top = e.agg(F.max("event_id") + 1).scalar()
    k, u = F.col("event_id"), F.col("user_id")
    pos = F.least(F.lit(3), F.floor(k * 1.0 / F.col("top") * 4 + F.when((u % 3 == 0) & (k % 7 == 0), -1).otherwise(0)))
    return (e.withColumn("top", top).withColumn("pos", pos).select(
        u.alias("case_id"), k.alias("item"), F.col("ts").cast("timestamp").alias("published_at"),
        F.when(F.col("pos") == 1, "filed").when(F.col("pos") == 2, "approved").when(F.col("pos") == 3, "closed")
        .otherwise("rumour").alias("stage"), (F.col("value") > 5).alias("verified"),
        F.when((u % 11 == 0) & (F.col("value") < 10), "http://x").otherwise("https://x").alias("url"),
        F.when(u % 5 == 0, "approved").otherwise("closed").alias("declared_stage")))


@view("cases", """
SELECT case_id, items, monotone, sourced, last_verified, declared, monotone AND sourced AND coalesce(last_verified = declared, false) AS valid FROM (
SELECT case_id, count(*) AS items, bool_and(prev IS NULL OR pos >= prev) AS monotone, bool_and(url LIKE 'https://%') AS sourced,
  arg_max(stage, (published_at, item)) FILTER (WHERE verified) AS last_verified, max(declared_stage) AS declared
FROM (SELECT *, lag(pos) OVER (PARTITION BY case_id ORDER BY published_at, item) AS prev
  FROM (SELECT *, CASE stage WHEN 'rumour' THEN 1 WHEN 'filed' THEN 2 WHEN 'approved' THEN 3 ELSE 4 END AS pos FROM timeline)) GROUP BY case_id)""")
def _cases(v):
    return screens.valid_cases(v.timeline, "case_id", STAGES)


@query("stage_monotone", "case_id:l items:l monotone:b sourced:b last_verified:s valid:b", "SELECT * FROM cases")
def _(v):
    return v.cases


@query("case_list", "valid_cases:l invalid_cases:l", """
SELECT count(*) FILTER (WHERE valid) AS valid_cases, count(*) FILTER (WHERE NOT valid) AS invalid_cases FROM cases""")
def _(v):
    return v.cases.agg(F.count_if("valid").alias("valid_cases"), F.count_if(~F.col("valid")).alias("invalid_cases"))


@query("stage_counts", "stage:s n:l", """
SELECT s.stage, count(c.case_id) AS n FROM (SELECT unnest(['rumour','filed','approved','closed']) AS stage) s LEFT JOIN cases c ON c.declared = s.stage GROUP BY 1""")
def _(v):
    # Every stage appears, also with no case: one zero per stage joins the per-stage counts before the sum.
    stages = v.spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"), F.lit(0).alias("n"))
    found = v.cases.groupBy(F.col("declared").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return stages.unionByName(found).groupBy("stage").agg(F.sum("n").alias("n"))


@query("clock_order", "report_id:l why:s", f"""
SELECT report_id, array_to_string(v, ';') AS why FROM (SELECT report_id, {_list([
    ("published_at > available_at", "published after available"), ("available_at > retrieved_at", "available after retrieved"),
    ("retrieved_at > recorded_at", "retrieved after recorded"), ("as_of > CAST(published_at AS DATE)", "as-of after published")])} AS v
FROM (SELECT report_id, as_of, CAST(as_of AS TIMESTAMP) + CAST(report_id % 11 AS INTEGER) * INTERVAL 1 DAY - INTERVAL 12 HOUR AS published_at, available AS available_at, retrieved AS retrieved_at,
  CAST(as_of AS TIMESTAMP) + INTERVAL 35 DAY AS recorded_at FROM reports)) WHERE len(v) > 0""")
def _(v):
    base = F.col("as_of").cast("timestamp")
    r = v.reports.select("report_id", "as_of", F.col("available").alias("available_at"), F.col("retrieved").alias("retrieved_at"),
                         F.timestamp_add("HOUR", ((F.col("report_id") % 11) * 24 - 12).cast("int"), base).alias("published_at"),
                         F.timestamp_add("DAY", F.lit(35), base).alias("recorded_at"))
    return screens.clock_violations(r).withColumn("why", F.array_join("violations", ";"))


@query("evidence_cutoff_filter", "report_id:l admissible:b refusal:s", """
SELECT report_id, r IS NULL AS admissible, r AS refusal FROM (SELECT report_id, CASE WHEN available > TIMESTAMP '1999-01-01' THEN 'after cutoff'
  WHEN report_id % 6 NOT BETWEEN 1 AND 4 THEN 'source tier' END AS r FROM reports)""")
def _(v):
    r = v.reports.select("report_id", F.col("available").alias("available_at"), (F.col("report_id") % 6).alias("source_tier"),
                         F.lit("1999-01-01").cast("timestamp").alias("cutoff"))
    return screens.admissible_evidence(r, "cutoff")


# --- set operations, top-k, appends ----------------------------------------------------------------------------------

def _pair(v):
    a = v.bars.filter(F.year("session_date") < 1999).select("ticker", "session_date", "close", "volume")
    b = v.bars.filter(F.year("session_date") > 1997).select("ticker", "session_date", (F.col("close") * 2).alias("close"), "volume")
    return a, b


@query("append_if_absent", KEY + "close:f", """
SELECT * FROM (SELECT ticker, session_date, close*2 AS close FROM bars WHERE year(session_date) > 1997) b
WHERE NOT EXISTS (SELECT 1 FROM bars a WHERE a.ticker=b.ticker AND a.session_date=b.session_date AND year(a.session_date) < 1999)""")
def _(v):
    a, b = _pair(v)
    return sets.append_if_absent(b.unionByName(b.withColumn("volume", F.col("volume") + 1)), a, ["ticker", "session_date"], ["volume"])


@query("append_counts", "appended:l refused:l", """
SELECT count(*) FILTER (WHERE year(session_date) > 1998) AS appended, count(*) + count(*) FILTER (WHERE year(session_date) = 1998) AS refused
FROM bars WHERE year(session_date) > 1997""")
def _(v):
    a, b = _pair(v)
    return sets.append_counts(b.unionByName(b), a, ["ticker", "session_date"])


@query("upsert_latest", KEY + "close:f version:l", """
SELECT ticker, session_date, CASE WHEN year(session_date) > 1997 THEN close*2 ELSE close END AS close, CASE WHEN year(session_date) > 1997 THEN 2 ELSE 1 END AS version FROM bars""")
def _(v):
    a, b = _pair(v)
    return sets.upsert_latest(b.withColumn("version", F.lit(2)), a.withColumn("version", F.lit(1)), ["ticker", "session_date"], "version")


@query("freeze_once", "week_ending:d bars:l volume:f2", """
SELECT w AS week_ending, count(*) AS bars, CASE WHEN year(w) < 1998 THEN -1e0 ELSE sum(volume) END AS volume
FROM (SELECT *, session_date + CAST((12 - isodow(session_date)) % 7 AS INTEGER) AS w FROM bars) GROUP BY w""")
def _(v):
    from tidemark.functions import friday_on_or_after
    weekly = v.bars.groupBy(friday_on_or_after("session_date").alias("week_ending")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))
    stored = weekly.filter(F.year("week_ending") < 1998).withColumn("volume", F.lit(-1.0))
    return sets.freeze_once(weekly, stored, "week_ending")


@query("latest_n_per_key", KEY + "rank:l close:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session_date DESC) AS rank FROM bars) WHERE rank <= 5""")
def _(v):
    return sets.latest_n_per_key(v.bars, ["ticker"], [F.desc("session_date")], 5)


@query("price_snapshot_retention", "user_id:l event_id:l rank:l", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, max(ts) OVER () AS newest FROM events)
WHERE rank <= {policy.SNAPSHOT_RETENTION} AND ts >= newest - INTERVAL 3 DAY""")
def _(v):
    e = v.table("events")
    newest = e.agg(F.max("ts")).scalar()
    recent = e.filter(F.col("ts") >= newest - F.expr("interval 3 days"))
    return sets.latest_n_per_key(recent, ["user_id"], [F.desc("ts"), F.desc("event_id")], policy.SNAPSHOT_RETENTION)


@query("latest_session_rows", KEY + "close:f", """
SELECT * FROM hist WHERE clean AND session_date = (SELECT max(session_date) FROM hist WHERE clean)""")
def _(v):
    return sets.latest_session_rows(v.hist.withColumn("eligible", F.col("clean")))


@view("pos", """
SELECT ticker, session_date, close, n, CASE WHEN i = 0 OR i = n-1 THEN -1 ELSE CAST(floor((i-1)/greatest(1, ceil((n-2)/179e0))) AS BIGINT) END AS b
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session_date)-1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars)""")
def _pos(v):
    from pyspark.sql import Window
    w = Window.partitionBy("ticker").orderBy("session_date")
    d = v.bars.select("ticker", "session_date", "close", F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("n"),
                      (F.row_number().over(w) - 1).alias("i"))
    size = F.greatest(F.lit(1), F.ceil((F.col("n") - 2) / 179))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return d.withColumn("b", F.when(ends, -1).otherwise(F.floor((F.col("i") - 1) / size)))


@query("downsample_minmax", KEY + "close:f", """
SELECT ticker, session_date, close FROM pos WHERE n <= 360 OR b < 0 UNION
SELECT ticker, unnest([arg_min(session_date, (close, session_date)), arg_min(session_date, (-close, session_date))]) AS session_date,
  unnest([min(close), max(close)]) AS close FROM pos WHERE n > 360 AND b >= 0 GROUP BY ticker, b""")
def _(v):
    return sets.downsample_minmax(v.bars)


@query("chrono_sort", KEY + "position:l", """
SELECT ticker, session_date, row_number() OVER (ORDER BY session_date, ticker)-1 AS position FROM bars""")
def _(v):
    return sets.global_position(v.bars.select("session_date", "ticker"), ["session_date", "ticker"])


@view("alerts", """
SELECT *, CASE WHEN p >= 0.35e0 AND p >= 2*base THEN 'research_alert' WHEN p >= 0.2e0 AND p >= 2*base THEN 'early_watch' ELSE 'abstain' END AS status
FROM (SELECT session_date, ticker, max(p) AS p, max(label) AS label, 0.1e0 + 0.1e0*(CAST(ticker AS BIGINT) % 3) AS base FROM preds GROUP BY 1, 2)""")
def _alerts(v):
    from tidemark.plans.journals import alert_status
    base = v.preds.groupBy("session_date", "ticker").agg(F.max("p").alias("p"), F.max("label").alias("label"))
    base = base.withColumn("base", 0.1 + 0.1 * (F.col("ticker").cast("bigint") % 3))
    return base.withColumn("status", alert_status("p", "base", F.lit(True), F.lit(True)))


@query("alert_budget", KEY + "p:f status:s budget_reason:s", """
SELECT session_date, ticker, p, CASE WHEN status <> 'abstain' AND rn > 5 THEN 'abstain' ELSE status END AS status,
  CASE WHEN status <> 'abstain' AND rn > 5 THEN 'daily alert budget reached' END AS budget_reason
FROM (SELECT *, row_number() OVER (PARTITION BY session_date, status <> 'abstain' ORDER BY p DESC, ticker) AS rn FROM alerts)""")
def _(v):
    return sets.alert_budget(v.alerts)


@query("union_aliases", "alias:s", "SELECT ticker AS alias FROM kinds UNION SELECT 'CIK:' || ticker FROM kinds UNION SELECT ticker FROM refs")
def _(v):
    return sets.union_aliases(v.kinds.select(F.col("ticker").alias("alias")),
                              v.kinds.select(F.concat(F.lit("CIK:"), "ticker").alias("alias")),
                              v.refs.select(F.col("ticker").alias("alias")))


@query("union_universe", "symbol:s list:l ordinal:l", """
SELECT symbol, min(l) AS list, arg_min(o, (l, o)) AS ordinal FROM (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 0 AS l, s_suppkey AS o FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 1, min(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY symbol""")
def _(v):
    a = v.table("supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("ordinal"))
    b = v.table("orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.min("o_orderkey").alias("ordinal"))
    return sets.union_universe([a, b])


@query("intersect_months", "month:d", """
SELECT month FROM monthly GROUP BY month HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM monthly)""")
def _(v):
    return sets.common_months(v.monthly)


@query("except_completed", "session_date:d", """
SELECT DISTINCT session_date FROM bars EXCEPT SELECT session_date FROM calendar_log WHERE status = 'complete'""")
def _(v):
    return sets.except_rows(v.bars.select("session_date").distinct(), v.calendar_log.filter("status = 'complete'"), ["session_date"])


@query("union_evidence", "ticker:s event_type:s n:l value:f2", """
SELECT ticker, event_type, count(*) AS n, sum(value) AS value FROM (SELECT ticker, event_type, value FROM iev WHERE event_type IN ('insider_buy','insider_sell')
UNION ALL SELECT ticker, event_type, NULL FROM iev WHERE event_type IN ('results','filing_event')) GROUP BY 1, 2""")
def _(v):
    trades = v.iev.filter(F.col("event_type").isin("insider_buy", "insider_sell"))
    filings = v.iev.filter(F.col("event_type").isin("results", "filing_event")).drop("value")
    return sets.union_evidence(trades, filings).groupBy("ticker", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("distinct_tickers", "ticker:s sessions:l", "SELECT ticker, count(DISTINCT session_date) AS sessions FROM bars GROUP BY 1")
def _(v):
    return v.bars.groupBy("ticker").agg(F.count_distinct("session_date").alias("sessions"))
