"""Queries over issuer events, the event study, cadence, the weekly radar and the mover screen."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import FWD
from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import events, frames
from tidemark.operators.sets import except_rows
from tidemark.plans import radar
from tidemark.session import reliable_checkpoint, spread
from tidemark.sources import filings

KEY = "ticker:s session_date:d "
TODAY = "1998-09-14"


@view("evf", """
SELECT h.ticker, h.session_date, least(365, h.session_date - max(CASE WHEN event_type='results' AND event_date <= h.session_date THEN event_date END)) AS days_since_results,
  least(365, h.session_date - max(CASE WHEN event_type='insider_buy' AND event_date <= h.session_date THEN event_date END)) AS days_since_insider_buy,
  CASE WHEN net = 0 THEN 0e0 ELSE sign(net)*log10(1e0+abs(net)) END AS insider_net_value_90d, CAST(material AS DOUBLE) AS material_filings_30d, events_visible
FROM (SELECT h.ticker, h.session_date, any_value(1) AS x, round(coalesce(sum(CASE WHEN e.event_date BETWEEN h.session_date-90 AND h.session_date THEN CASE event_type WHEN 'insider_buy' THEN value WHEN 'insider_sell' THEN -value END END), 0), 2) AS net,
    count(*) FILTER (WHERE event_type='filing_event' AND e.event_date BETWEEN h.session_date-30 AND h.session_date) AS material, count(e.ticker) AS events_visible,
    max(CASE WHEN event_type='results' AND e.event_date <= h.session_date THEN e.event_date END) AS rd, max(CASE WHEN event_type='insider_buy' AND e.event_date <= h.session_date THEN e.event_date END) AS bd
  FROM hist h LEFT JOIN iev e ON e.ticker = h.ticker AND greatest(e.published_at, e.available_at) <= (CAST(h.session_date AS TIMESTAMP) + INTERVAL '16 hours 15 minutes') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'
  GROUP BY 1, 2) h""".replace("h.session_date - max(CASE WHEN event_type='results' AND event_date <= h.session_date THEN event_date END)", "h.session_date - rd")
      .replace("h.session_date - max(CASE WHEN event_type='insider_buy' AND event_date <= h.session_date THEN event_date END)", "h.session_date - bd"))
def _evf(v):
    return events.event_features(v.hist, v.iev)


@query("event_features", KEY + "days_since_results:f days_since_insider_buy:f insider_net_value_90d:f material_filings_30d:f events_visible:l", "SELECT * FROM evf")
def _(v):
    return v.evf


@query("interval_events_join", "ticker:s sessions:l visible:l material:f net:f4", """
SELECT ticker, count(*) AS sessions, sum(events_visible) AS visible, sum(material_filings_30d) AS material, sum(insider_net_value_90d) AS net FROM evf GROUP BY 1""")
def _(v):
    return v.evf.groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events_visible").alias("visible"),
                                       F.sum("material_filings_30d").alias("material"), F.sum("insider_net_value_90d").alias("net"))


@query("load_events", "ticker:s event_date:d event_type:s accession:l available_at:t", "SELECT * FROM iev WHERE ticker IN ('1', '3', '7')")
def _(v):
    return filings.scan_events(v.iev, ["1", "3", "7"])


# --- filings ---------------------------------------------------------------------------------------------------------

_FORMS = ["8-K", "4", "10-Q", "6-K"]
_ITEMS = ["2.02,9.01", "", "5.07", "7.01, 8.01 ,3.09"]


@view("filing_rows", """
SELECT o_custkey AS cik, o_orderkey*10+i AS accession, list_extract(['8-K','4','10-Q','6-K'], CAST((o_orderkey+i) % 4 + 1 AS BIGINT)) AS form,
  CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS filed_on, list_extract(['2.02,9.01','','5.07','7.01, 8.01 ,3.09'], CAST((o_orderkey*3+i) % 4 + 1 AS BIGINT)) AS items
FROM orders, (SELECT unnest([0,1,2,3]) AS i) n""")
def _filing_rows(v):
    return filings.explode_filings(v.filing_index, _FORMS, "cik", ["accession", "form", "filed_on", "items"])


@view("filing_index", "SELECT 1 AS unused")
def _filing_index(v):
    """One index document per order: parallel arrays, as a filing service publishes them."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms, items = F.array(*[F.lit(f) for f in _FORMS]), F.array(*[F.lit(i) for i in _ITEMS])
    return v.table("orders").select(
        F.col("o_custkey").alias("cik"), F.array(*[k * 10 + i for i in range(4)]).alias("accession"),
        F.array(*[F.get(forms, ((k + i) % 4).cast("int")) for i in range(4)]).alias("form"),
        F.array(*[F.date_add(d, i) for i in range(4)]).alias("filed_on"),
        F.array(*[F.get(items, ((k * 3 + i) % 4).cast("int")) for i in range(4)]).alias("items"))


@query("explode_filing_index", "cik:l accession:l form:s filed_on:d items:s", "SELECT * FROM filing_rows WHERE form IN ('8-K', '6-K')")
def _(v):
    return filings.explode_filings(v.filing_index, ["8-K", "6-K"], "cik", ["accession", "form", "filed_on", "items"])


_MEAN = "CASE item " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in filings.ITEM_MEANINGS.items()) + " ELSE 'Item ' || item END"


@view("item_rows", f"""
SELECT *, {_MEAN} AS meaning, item NOT IN ('9.01', '5.07') AS material, item = '2.02' AS results
FROM (SELECT *, trim(unnest(string_split(items, ','))) AS item FROM filing_rows WHERE form IN ('8-K', '6-K')) WHERE item <> ''""")
def _item_rows(v):
    return filings.filing_items(v.filing_rows.filter(F.col("form").isin("8-K", "6-K")))


@query("filing_items", "cik:l accession:l item:s meaning:s material:b results:b", "SELECT * FROM item_rows")
def _(v):
    return v.item_rows


@view("tx", """
SELECT ticker, CAST(available_at AS DATE) AS filed_on, event_date AS transaction_date, published_at, available_at, value, accession, 'O' || accession % 25 AS owner, accession % 4 = 0 AS planned,
  CASE WHEN accession % 6 = 0 THEN 'A' WHEN event_type = 'insider_buy' THEN 'P' WHEN event_type = 'insider_sell' THEN 'S' WHEN event_type = 'results' THEN 'F' ELSE 'J' END AS code FROM iev""")
def _tx(v):
    k, t = F.col("accession"), F.col("event_type")
    return v.iev.select("ticker", F.to_date("available_at").alias("filed_on"), F.col("event_date").alias("transaction_date"), "published_at", "available_at",
                        "value", "accession", F.concat(F.lit("O"), (k % 25).cast("string")).alias("owner"), (k % 4 == 0).alias("planned"),
                        F.when(k % 6 == 0, "A").when(t == "insider_buy", "P").when(t == "insider_sell", "S").when(t == "results", "F").otherwise("J").alias("code"))


def _win(d):
    live = f"filed_on >= DATE '{TODAY}' - {d}"
    return f"""count(*) FILTER (WHERE code='P' AND {live}) AS buys_{d}, count(*) FILTER (WHERE code='S' AND {live}) AS sells_{d},
 count(*) FILTER (WHERE code='S' AND {live} AND NOT planned) AS unplanned_sells_{d}, coalesce(sum(value) FILTER (WHERE code='P' AND {live}),0) AS buy_value_{d},
 coalesce(sum(value) FILTER (WHERE code='P' AND {live}),0) - coalesce(sum(value) FILTER (WHERE code='S' AND {live}),0) AS net_value_{d}, count(DISTINCT owner) FILTER (WHERE code='P' AND {live}) AS buyers_{d}"""


@query("insider_summary", "ticker:s last_buy:d days_since_buy:l routine:l " + " ".join(
    f"buys_{d}:l sells_{d}:l unplanned_sells_{d}:l buy_value_{d}:f2 net_value_{d}:f2 buyers_{d}:l" for d in (30, 90, 180)), f"""
SELECT ticker, max(filed_on) FILTER (WHERE code='P') AS last_buy, DATE '{TODAY}' - max(filed_on) FILTER (WHERE code='P') AS days_since_buy,
 count(*) FILTER (WHERE code IN ('A','M','F','G','C','D','I')) AS routine, {_win(30)}, {_win(90)}, {_win(180)} FROM tx WHERE filed_on <= DATE '{TODAY}' GROUP BY 1""")
def _(v):
    return events.insider_summary(v.tx, F.lit(TODAY).cast("date"))


@query("store_issuer_events", "ticker:s event_type:s accession:l event_date:d detail:s value:f2", """
SELECT DISTINCT ticker, CASE code WHEN 'P' THEN 'insider_buy' ELSE 'insider_sell' END AS event_type, accession, transaction_date AS event_date, owner AS detail, value FROM tx
WHERE code IN ('P','S') AND year(transaction_date) > 1997
UNION SELECT CAST(cik % 100 AS VARCHAR), CASE WHEN item='2.02' THEN 'results' ELSE 'filing_event' END, accession, filed_on, item, NULL FROM item_rows WHERE year(filed_on) > 1997""")
def _(v):
    items = v.item_rows.withColumn("ticker", (F.col("cik") % 100).cast("string")).withColumn("published_at", F.col("filed_on").cast("timestamp")).withColumn("available_at", F.col("published_at"))
    rows = events.issuer_event_rows(v.tx, items)
    stored = rows.filter(F.year("event_date") <= 1997)
    return except_rows(rows, stored, ["ticker", "event_type", "accession", "event_date", "detail"])


# --- event study -----------------------------------------------------------------------------------------------------

_PAIRS = [(e, x) for e in (-5, -3, -1, 0) for x in (0, 1, 2, 5, 10) if x > e]


def _at(col, o):
    return f"{'lead' if o >= 0 else 'lag'}({col}, {abs(o)}) OVER (PARTITION BY ticker ORDER BY session_date)"


_AROUND = ", ".join(f"{_at(c, o)} AS {n}{'m' if o < 0 else 'p'}{abs(o)}" for o in (-5, -3, -1, 0, 1, 2, 5, 10) for c, n in (("close", "c"), ("bench_close", "b")))
_COMBO = " UNION ALL ".join(f"""SELECT ticker, event_date, reaction_date, {i} AS combo, {e} AS entry_offset, {x} AS exit_offset,
 ((cp{x}/c{'m' if e < 0 else 'p'}{abs(e)}-1)-(bp{x}/b{'m' if e < 0 else 'p'}{abs(e)}-1))*100 AS excess FROM around""" for i, (e, x) in enumerate(_PAIRS))


@view("around", f"SELECT r.ticker, r.event_date, r.reaction_date, a.* EXCLUDE (ticker, session_date) FROM reactions r JOIN (SELECT ticker, session_date, {_AROUND} FROM hist) a ON a.ticker = r.ticker AND a.session_date = r.reaction_date")
def _around(v):
    return v.reactions


@view("study", f"SELECT * FROM ({_COMBO}) WHERE excess IS NOT NULL")
def _study(v):
    return events.announcement_windows(v.hist, v.iev.filter("event_type = 'results'"))


@query("event_window_stats", "entry_offset:l exit_offset:l events:l sufficient:b mean_excess:f median_excess:f net_of_costs:f win_rate:f spread:f worst:f best:f lower95:f upper95:f beats_costs:b", """
WITH s AS (SELECT entry_offset, exit_offset, reaction_date, sum(excess) AS num, count(*) AS den FROM study GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY entry_offset, exit_offset ORDER BY reaction_date)-1 AS slot, count(*) OVER (PARTITION BY entry_offset, exit_offset) AS n FROM s),
d AS (SELECT entry_offset, exit_offset, r, CAST('0x' || substr(md5('20260804-' || r || '-' || slot), 1, 8) AS BIGINT) % n AS slot FROM k, (SELECT unnest(generate_series(0, 399)) AS r) WHERE n >= 3),
e AS (SELECT d.entry_offset, d.exit_offset, d.r, sum(num)/sum(den) AS e FROM d JOIN k USING (entry_offset, exit_offset, slot) GROUP BY 1, 2, 3),
a AS (SELECT entry_offset, exit_offset, list_sort(list(e)) AS a FROM e GROUP BY 1, 2 HAVING count(*) >= 20),
ci AS (SELECT entry_offset, exit_offset, a[1+CAST(floor(0.025e0*(len(a)-1)) AS BIGINT)] AS lo, a[1+CAST(floor(0.975e0*(len(a)-1)) AS BIGINT)] AS hi FROM a)
SELECT m.entry_offset, m.exit_offset, n AS events, n >= 100 AS sufficient, CASE WHEN n >= 100 THEN a END AS mean_excess, CASE WHEN n >= 100 THEN md END AS median_excess, CASE WHEN n >= 100 THEN a - 0.2 END AS net_of_costs,
 CASE WHEN n >= 100 THEN w END AS win_rate, CASE WHEN n >= 100 THEN sd END AS spread, CASE WHEN n >= 100 THEN mn END AS worst, CASE WHEN n >= 100 THEN mx END AS best,
 CASE WHEN n >= 100 THEN lo END AS lower95, CASE WHEN n >= 100 THEN hi END AS upper95, n >= 100 AND coalesce(lo > 0.2, false) AS beats_costs
FROM (SELECT entry_offset, exit_offset, count(*) AS n, avg(excess) AS a, median(excess) AS md, avg(CASE WHEN excess > 0 THEN 1e0 ELSE 0e0 END) AS w, stddev_pop(excess) AS sd, min(excess) AS mn, max(excess) AS mx FROM study GROUP BY 1, 2) m
LEFT JOIN ci USING (entry_offset, exit_offset)""")
def _(v):
    return events.event_window_stats(v.study)


@query("event_study", "announcements:l securities:l windows_tested:l", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT ticker, event_date FROM study)) AS announcements, (SELECT count(DISTINCT ticker) FROM study) AS securities,
 (SELECT count(*) FROM (SELECT entry_offset FROM study GROUP BY entry_offset, exit_offset HAVING count(*) >= 100)) AS windows_tested""")
def _(v):
    return events.event_study(v.study)


@query("event_window_interval", "entry_offset:l exit_offset:l lower95:f upper95:f clusters:l", """
WITH s AS (SELECT entry_offset, exit_offset, reaction_date, sum(excess) AS num, count(*) AS den FROM study GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY entry_offset, exit_offset ORDER BY reaction_date)-1 AS slot, count(*) OVER (PARTITION BY entry_offset, exit_offset) AS n FROM s),
d AS (SELECT entry_offset, exit_offset, r, CAST('0x' || substr(md5('20260804-' || r || '-' || slot), 1, 8) AS BIGINT) % n AS slot FROM k, (SELECT unnest(generate_series(0, 399)) AS r)),
e AS (SELECT d.entry_offset, d.exit_offset, d.r, sum(num)/sum(den) AS e FROM d JOIN k USING (entry_offset, exit_offset, slot) GROUP BY 1, 2, 3),
a AS (SELECT entry_offset, exit_offset, list_sort(list(e)) AS a FROM e GROUP BY 1, 2)
SELECT entry_offset, exit_offset, a[1+CAST(floor(0.025e0*(len(a)-1)) AS BIGINT)] AS lower95, a[1+CAST(floor(0.975e0*(len(a)-1)) AS BIGINT)] AS upper95,
 (SELECT max(n) FROM k WHERE k.entry_offset = a.entry_offset AND k.exit_offset = a.exit_offset) AS clusters FROM a""")
def _(v):
    from tidemark.operators.scores import cluster_bootstrap
    return cluster_bootstrap(v.study, "reaction_date", F.col("excess"), F.lit(1), by=["entry_offset", "exit_offset"])


@query("theta_cross_joins", "entry_offset:l exit_offset:l tickers:l", "SELECT entry_offset, exit_offset, count(DISTINCT ticker) AS tickers FROM study GROUP BY 1, 2")
def _(v):
    # Offsets multiply each event through an array of structs, not through a join.
    return v.study.groupBy("entry_offset", "exit_offset").agg(F.count_distinct("ticker").alias("tickers"))


@query("persistence_check", "securities:l carried_mean:f all_window_mean:f advantage:f beat_rate:f", """
SELECT count(*) AS securities, avg(carried) AS carried_mean, avg(average) AS all_window_mean, avg(carried-average) AS advantage, avg(CASE WHEN carried-average > 0 THEN 1e0 ELSE 0e0 END) AS beat_rate
FROM (SELECT ticker, arg_max_null(late, (early, -combo)) FILTER (WHERE early IS NOT NULL) AS carried, avg(late) AS average FROM (
  SELECT s.ticker, combo, avg(excess) FILTER (WHERE rn <= half) AS early, avg(excess) FILTER (WHERE rn > half) AS late FROM study s
  JOIN (SELECT *, n // 2 AS half FROM (SELECT ticker, reaction_date, event_date, row_number() OVER (PARTITION BY ticker ORDER BY reaction_date, event_date) AS rn, count(*) OVER (PARTITION BY ticker) AS n
    FROM (SELECT DISTINCT ticker, reaction_date, event_date FROM study)) WHERE n // 2 >= 4 AND n - n // 2 >= 4) h
  ON h.ticker = s.ticker AND h.reaction_date = s.reaction_date AND h.event_date = s.event_date GROUP BY 1, 2) GROUP BY 1) WHERE carried IS NOT NULL AND average IS NOT NULL""")
def _(v):
    return events.persistence(v.study)


@query("move_timing", "ticker:s events:l reaction_move:f other_day_move:f reaction_share:f times_ordinary:f", """
SELECT ticker, events, m AS reaction_move, rest/4 AS other_day_move, m/(m+rest) AS reaction_share, m/nullif(rest/4,0) AS times_ordinary FROM (
 SELECT r.ticker, count(*) AS events, avg(a0) AS m, avg(a1+a2+a3+a4) AS rest FROM reactions r JOIN (
  SELECT ticker, session_date, a AS a0, lead(a,1) OVER w AS a1, lead(a,2) OVER w AS a2, lead(a,3) OVER w AS a3, lead(a,4) OVER w AS a4 FROM (SELECT ticker, session_date, abs((r-rb)*100) AS a FROM rets)
  WINDOW w AS (PARTITION BY ticker ORDER BY session_date)) q ON q.ticker = r.ticker AND q.session_date = r.reaction_date
 WHERE a0+a1+a2+a3+a4 IS NOT NULL GROUP BY 1) WHERE events >= 3 AND m + rest <> 0""")
def _(v):
    return events.move_timing(v.hist, v.iev.filter("event_type = 'results'"))


@query("reaction_sizes", "ticker:s events:l typical:f smallest:f largest:f ordinary:f multiple:f", """
SELECT *, typical/nullif(ordinary,0) AS multiple FROM (SELECT m.ticker, count(r.reaction_date) AS events, median(CASE WHEN r.reaction_date IS NOT NULL THEN abs(round(mv,2)) END) AS typical,
 min(CASE WHEN r.reaction_date IS NOT NULL THEN abs(round(mv,2)) END) AS smallest, max(CASE WHEN r.reaction_date IS NOT NULL THEN abs(round(mv,2)) END) AS largest, median(CASE WHEN r.reaction_date IS NULL THEN abs(mv) END) AS ordinary
FROM (SELECT ticker, session_date, (r-rb)*100 AS mv FROM rets WHERE r IS NOT NULL) m LEFT JOIN (SELECT DISTINCT ticker, reaction_date FROM reactions) r ON r.ticker = m.ticker AND r.reaction_date = m.session_date GROUP BY 1) WHERE events > 0""")
def _(v):
    return events.reaction_sizes(frames.session_moves(v.hist), v.reactions)


# --- cadence ---------------------------------------------------------------------------------------------------------

@view("announced", """
SELECT ticker, min(event_date) AS event_date FROM iev WHERE event_type = 'results' AND event_date < DATE '1998-08-01' GROUP BY ticker, year(event_date)*4 + quarter(event_date)""")
def _announced(v):
    d = F.col("event_date")
    return (v.iev.filter("event_type = 'results' AND event_date < DATE '1998-08-01'").groupBy("ticker", (F.year(d) * 4 + F.quarter(d)).alias("q"))
            .agg(F.min(d).alias("event_date")).drop("q"))


_MED = "(({a})[(len({a})-1)//2+1] + ({a})[len({a})//2+1])/2e0"


@view("cadence", f"""
SELECT *, CASE WHEN status <> 'projected' THEN 'unknown' WHEN overdue THEN 'overdue' WHEN window_open THEN 'window-open' WHEN days_away BETWEEN 0 AND 14 THEN 'approaching' ELSE 'clear' END AS flag,
 CASE WHEN half_width <= 5 THEN 'firm' WHEN half_width <= 9 THEN 'approximate' WHEN status = 'projected' THEN 'wide' END AS precision FROM (
SELECT *, expected_date - half_width AS window_start, expected_date + half_width AS window_end, expected_date - DATE '{TODAY}' AS days_away,
 DATE '{TODAY}' BETWEEN expected_date - half_width AND expected_date + half_width AS window_open, DATE '{TODAY}' > expected_date + half_width AS overdue FROM (
SELECT *, CASE WHEN status = 'projected' THEN last_confirmed + typical_gap END AS expected_date, CASE WHEN status = 'projected' THEN least(14, greatest(4, CAST(round_even(spread/2e0, 0) AS INTEGER)+2)) END AS half_width FROM (
SELECT *, CASE WHEN dates < 4 THEN 'insufficient-history' WHEN gaps < 3 THEN 'irregular-cadence' WHEN spread > 28 THEN 'irregular-cadence' ELSE 'projected' END AS status FROM (
SELECT *, len(g) AS gaps, CASE WHEN len(g) >= 3 THEN CAST(floor({_MED.format(a="hi")} - {_MED.format(a="lo")}) AS INTEGER) END AS spread, CASE WHEN len(g) >= 3 THEN CAST(floor({_MED.format(a="g")}) AS INTEGER) END AS typical_gap FROM (
SELECT *, g[1:len(g)//2] AS lo, g[len(g)//2+1+len(g)%2:] AS hi FROM (
SELECT ticker, count(*) AS dates, max(event_date) AS last_confirmed, coalesce(list_sort(list(gap) FILTER (WHERE gap BETWEEN 70 AND 110)), []) AS g
FROM (SELECT ticker, event_date, event_date - lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date) AS gap FROM announced) GROUP BY 1))))))""")
def _cadence(v):
    return events.announcement_cadence(v.announced, F.lit(TODAY).cast("date"))


CAD = "ticker:s dates:l gaps:l status:s spread:l typical_gap:l last_confirmed:d expected_date:d half_width:l window_start:d window_end:d days_away:l window_open:b overdue:b flag:s precision:s"


@query("announcement_cadence", CAD, "SELECT * FROM cadence")
def _(v):
    return v.cadence


@query("earnings_radar", "ticker:s kind:s expected_date:d flag:s", """
SELECT * FROM (SELECT *, CASE WHEN status <> 'projected' THEN 'unresolved' WHEN NOT overdue AND (window_open OR days_away BETWEEN 0 AND 14) THEN 'upcoming' END AS kind FROM cadence) WHERE kind IS NOT NULL""")
def _(v):
    return events.earnings_radar(v.cadence)


# --- radar -----------------------------------------------------------------------------------------------------------

_B = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} < 0.35e0 THEN 'calm' WHEN {0} < 0.6e0 THEN 'normal' WHEN {0} < 0.95e0 THEN 'lively' ELSE 'wild' END"
_SHIFT = "(CASE WHEN CAST(ticker AS BIGINT) % 8 = 0 THEN 0.05e0 WHEN CAST(ticker AS BIGINT) % 8 = 1 THEN 0.1e0 ELSE 1e0 END)"


@view("calm_hist", f"SELECT * EXCLUDE (close), bench_close*(1e0 + {_SHIFT}*(close/bench_close-1e0)) AS close FROM hist")
def _calm(v):
    """Histories pulled towards the benchmark by a factor per ticker, so that every volatility band occurs."""
    k = F.col("ticker").cast("bigint") % 8
    shift = F.when(k == 0, 0.05).when(k == 1, 0.1).otherwise(1.0)
    return v.hist.withColumn("close", F.col("bench_close") * (1.0 + shift * (F.col("close") / F.col("bench_close") - 1.0)))


@query("min_history_filter", "ticker:s n:l", "SELECT ticker, count(*) AS n FROM hist WHERE security_type IN ('common_stock','adr') GROUP BY 1 HAVING count(*) >= 150")
def _(v):
    return radar.min_history(v.hist).filter("idx = 0").select("ticker", "n")


@view("radar_rows", f"""
SELECT *, {_B.format('vp')} AS band_p, {_B.format('vc')} AS band_c FROM (
SELECT h.*, {FWD} AS m, CASE WHEN idx >= 21 THEN stddev_pop(r) OVER w21*sqrt(252e0) END AS vp, CASE WHEN idx >= 9 THEN stddev_pop(r) OVER w21*sqrt(252e0) END AS vc,
 CASE WHEN count(dollar_volume) OVER w61 >= 20 THEN quantile_cont(dollar_volume,0.5) OVER w5/nullif(quantile_cont(dollar_volume,0.5) OVER w61,0) END AS volume_build,
 coalesce(max(due) OVER (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),0)=1 AS results_due
FROM (SELECT c.*, CASE WHEN e.event_date IS NOT NULL THEN 1 END AS due, close/lag(close) OVER (PARTITION BY c.ticker ORDER BY session_date)-1 AS r FROM calm_hist c
  LEFT JOIN announced e ON e.ticker = c.ticker AND e.event_date = c.session_date WHERE n >= 150 AND security_type IN ('common_stock','adr')) h
WINDOW w21 AS (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), w61 AS (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW),
 w5 AS (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def _radar_rows(v):
    return radar.radar_frame(radar.min_history(v.calm_hist), v.announced)


_T = "avg(CASE WHEN m >= 0.03e0 THEN 1e0 ELSE 0e0 END) AS {0}t3, avg(CASE WHEN m >= 0.05e0 THEN 1e0 ELSE 0e0 END) AS {0}t5, avg(CASE WHEN m >= 0.075e0 THEN 1e0 ELSE 0e0 END) AS {0}t7_5, avg(CASE WHEN m >= 0.1e0 THEN 1e0 ELSE 0e0 END) AS {0}t10"


@view("cohorts", f"""SELECT results_due, band_p AS band, count(*) AS sessions, count(*) FILTER (WHERE m >= 0.1e0) AS jumps, {_T.format('')}, count(*) >= 200 AS sufficient
FROM radar_rows WHERE idx >= 21 AND m IS NOT NULL GROUP BY 1, 2""")
def _cohorts(v):
    return radar.cohort_rates(v.radar_rows)


@query("cohort_jump_rates", "results_due:b band:s sessions:l jumps:l t3:f t5:f t7_5:f t10:f sufficient:b", "SELECT * FROM cohorts")
def _(v):
    return v.cohorts


@view("owns", f"SELECT ticker, count(*) AS own_sessions, count(*) FILTER (WHERE m >= 0.1e0) AS own_jumps, {_T.format('own_')} FROM radar_rows WHERE idx >= n-257 AND m IS NOT NULL GROUP BY 1")
def _owns(v):
    return radar.own_rates(v.radar_rows)


@query("own_jump_rate", "ticker:s own_sessions:l own_jumps:l own_t3:f own_t5:f own_t7_5:f own_t10:f", "SELECT * FROM owns")
def _(v):
    return v.owns


def _blend(t):
    return f"""CASE WHEN c.{t} IS NULL THEN round(o.own_{t},4) WHEN o.own_{t} IS NULL THEN round(c.{t},4)
 ELSE round(round(c.{t},4)*(1-least(0.5e0, own_sessions/(own_sessions+250e0))) + round(o.own_{t},4)*least(0.5e0, own_sessions/(own_sessions+250e0)) + 1e-9, 4) END AS chance_{t}"""


@view("candidates", f"""
SELECT * FROM (SELECT r.ticker, r.session_date AS as_of, r.band_c AS band, r.due_now AS results_due, r.expected_date, c.sessions, o.own_sessions, {_blend('t3')}, {_blend('t5')}, {_blend('t7_5')}, {_blend('t10')},
  nullif(round(r.volume_build, 3), 0) AS volume_build, r.vc AS volatility
FROM (SELECT r.*, k.expected_date, coalesce(days_away BETWEEN 0 AND 7 OR (window_open AND NOT overdue), false) AS due_now FROM radar_rows r LEFT JOIN cadence k ON k.ticker = r.ticker WHERE idx = n-1 AND vc IS NOT NULL) r
LEFT JOIN cohorts c ON c.results_due = r.due_now AND c.band = r.band_c LEFT JOIN owns o ON o.ticker = r.ticker) WHERE chance_t10 IS NOT NULL""")
def _candidates(v):
    return radar.weekly_candidates(v.calm_hist, v.announced, F.lit(TODAY).cast("date"))


CAND = "ticker:s as_of:d band:s results_due:b expected_date:d sessions:l own_sessions:l chance_t3:f4 chance_t5:f4 chance_t7_5:f4 chance_t10:f4 volume_build:f2 volatility:f"


@query("weekly_candidates", CAND, "SELECT * FROM candidates")
def _(v):
    return v.candidates


@query("shortlist_top_k", CAND, "SELECT * FROM candidates ORDER BY chance_t10 DESC, ticker LIMIT 5")
def _(v):
    return radar.shortlist(v.candidates)


@query("ranking", "ticker:s rank:l chance_t10:f4", "SELECT ticker, row_number() OVER (ORDER BY chance_t10 DESC, ticker) AS rank, chance_t10 FROM candidates")
def _(v):
    from tidemark.operators.sets import global_position
    ranked = global_position(v.candidates.select("ticker", "chance_t10", (-F.col("chance_t10")).alias("_o")), ["_o", "ticker"], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


# --- movers ----------------------------------------------------------------------------------------------------------

@view("dense_bars", """
SELECT s.session_date, k.ticker, c.bench_close*(1e0 + ((CAST(k.ticker AS BIGINT)*7919 + c.ordinal*104729) % 1000 - 500)/4000e0) AS close, 1000e0 + (CAST(k.ticker AS BIGINT)*31 + c.ordinal*17) % 500 AS volume
FROM (SELECT session_date, bench_close, row_number() OVER (ORDER BY session_date)-1 AS ordinal FROM bench) c JOIN (SELECT DISTINCT session_date FROM bars) s ON s.session_date = c.session_date, kinds k
WHERE (CAST(k.ticker AS BIGINT) + c.ordinal) % 9 <> 0""")
def _dense(v):
    """A daily bar for most tickers on most sessions: the ship-date bars are too sparse for a daily screen."""
    from tidemark.operators.joins import calendar_ordinal
    k, o = F.col("ticker").cast("bigint"), F.col("ordinal")
    calendar = reliable_checkpoint(v.bench.join(calendar_ordinal(v.bench), "session_date"))
    # A product and not an exploded list: of a list's length the planner knows nothing, and would broadcast all bars.
    every = spread(v.kinds.select("ticker")).crossJoin(F.broadcast(calendar))
    return every.filter((k + o) % 9 != 0).select(
        "session_date", "ticker", (F.col("bench_close") * (1.0 + ((k * 7919 + o * 104729) % 1000 - 500) / 4000.0)).alias("close"),
        (1000.0 + (k * 31 + o * 17) % 500).alias("volume"))


@view("causes", "SELECT ticker, session_date, CASE WHEN CAST(ticker AS BIGINT) % 3 = 0 THEN 'verified' ELSE 'open' END AS status, 'wire' AS source, CASE WHEN CAST(ticker AS BIGINT) % 2 = 0 THEN 'https://x' ELSE '' END AS url, 'cause ' || ticker AS cause FROM dense_bars")
def _causes(v):
    k = F.col("ticker").cast("bigint")
    return v.dense_bars.select("ticker", "session_date", F.when(k % 3 == 0, "verified").otherwise("open").alias("status"), F.lit("wire").alias("source"),
                               F.when(k % 2 == 0, "https://x").otherwise("").alias("url"), F.concat(F.lit("cause "), "ticker").alias("cause"))


_MV = """
SELECT *, row_number() OVER (ORDER BY abs(relative_move) DESC, ticker) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY relative_move > 0 ORDER BY abs(relative_move) DESC, ticker) AS rn, CASE WHEN relative_move > 0 THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT t.*, r.active, r.raw_type, c.cause FROM (SELECT m.*, close/prior_close-1-(bench_close/pb-1) AS relative_move, close/prior_close-1 AS move, o - po - 1 AS skipped_sessions FROM (
    SELECT b.ticker, b.session_date, b.close, b.o, b.bench_close, lag(b.close) OVER w AS prior_close, lag(b.o) OVER w AS po, lag(b.bench_close) OVER w AS pb, row_number() OVER w - 1 AS prior_rows,
      lag(b.close,1) OVER w/lag(b.close,6) OVER w-1 AS return_5d, quantile_cont(b.close*b.volume,0.5) OVER (PARTITION BY b.ticker ORDER BY b.session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mdv
    FROM (SELECT d.*, c.o, c.bench_close FROM dense_bars d JOIN (SELECT session_date, bench_close, row_number() OVER (ORDER BY session_date)-1 AS o FROM bench) c ON c.session_date = d.session_date
      WHERE c.o >= (SELECT count(*)-1-160 FROM bench)) b WINDOW w AS (PARTITION BY b.ticker ORDER BY b.session_date)) m
    WHERE o = (SELECT count(*)-1 FROM bench) AND close >= 2 AND prior_close > 0) t
  ASOF LEFT JOIN refs r ON r.ticker = t.ticker AND t.session_date >= r.snapshot_date LEFT JOIN (SELECT * FROM causes WHERE status='verified' AND url <> '') c ON c.ticker = t.ticker AND c.session_date = t.session_date)
 WHERE active AND raw_type IN ('CS','ADRC','ADRP','GDR') AND prior_rows >= 126 AND mdv >= 100000 AND relative_move <> 0) WHERE rn <= 4"""


@query("daily_movers", KEY + "rank:l direction:s relative_move:f move:f prior_rows:l return_5d:f skipped_sessions:l cause:s", _MV)
def _(v):
    return radar.daily_movers(v.dense_bars, v.bench, v.refs, v.causes, min_volume=100000.0)


@query("top_movers", KEY + "move:f", """
SELECT * FROM (SELECT *, close/lag(close) OVER (PARTITION BY ticker ORDER BY session_date)-1 AS move FROM bars) WHERE move IS NOT NULL ORDER BY abs(move) DESC, ticker, session_date LIMIT 500""")
def _(v):
    m = frames.daily_return(v.bars, name="move").filter("move IS NOT NULL")
    return m.orderBy(F.desc(F.abs("move")), "ticker", "session_date").limit(500)
