"""Queries over observations, archive checks, the ledger and fund evidence."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.screens import _FAILED, _MISSING, _list, _with_raw
from tidemark.catalog.views import view
from tidemark.functions import content_address
from tidemark.operators import frames, intervals, joins, screens
from tidemark.plans import ledger as lg, observations as ob
from tidemark.session import reliable_checkpoint, spread
from tidemark.sources.bars import latest_close

KEY = "ticker:s session_date:d "


def canon(*cols):
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols) + "))"


# --- observations ----------------------------------------------------------------------------------------------------

def _lab(n):
    ok = f"coalesce(cac AND c{n} AND close > 0 AND p{n} > 0 AND bench_close > 0 AND b{n} > 0, false)"
    ex = f"((p{n}/close-1)-(b{n}/bench_close-1))"
    t = 0.10 if n == 1 else 0.15
    return f"CASE WHEN {ok} THEN 'ready' ELSE 'quarantined' END AS label_status_{n}, CASE WHEN {ok} THEN {ex} END AS excess_{n}, CASE WHEN {ok} THEN CASE WHEN abs({ex}) >= {t}e0 THEN CASE WHEN {ex} > 0 THEN 'up' ELSE 'down' END ELSE 'none' END END AS direction_{n}"


@view("bench_dividends", "SELECT min(session_date) AS event_date, arg_min(bench_close, session_date)*CASE WHEN year(session_date) = 1995 THEN 2e0 ELSE 0.003e0 END AS cash FROM bench GROUP BY year(session_date), quarter(session_date)")
def _bench_dividends(v):
    """Four a year; one that exceeds the price spoils what comes before it."""
    d = F.col("session_date")
    first = v.bench.groupBy(F.year(d).alias("y"), F.quarter(d)).agg(F.min(d).alias("event_date"), F.min_by("bench_close", d).alias("c"))
    return first.select("event_date", (F.col("c") * F.when(F.col("y") == 1995, 2.0).otherwise(0.003)).alias("cash"))


@view("listed", "SELECT *, CASE WHEN CAST(ticker AS BIGINT) % 3 = 1 THEN 'SHR' || ticker END AS share_class_figi FROM refs")
def _listed(v):
    return v.refs.withColumn("share_class_figi", F.when(F.col("ticker").cast("bigint") % 3 == 1, F.concat(F.lit("SHR"), "ticker")))


@view("action_requests", "SELECT 1 AS unused")
def _action_requests(v):
    """Quarterly requests of both endpoints that adjoin or overlap; of dividends those of the third quarter of 1996 came a year late,
    and those of the third quarter of 1997 are missing."""
    days = v.bench.agg(F.min("session_date").alias("a"), F.date_add(F.max("session_date"), 30).alias("z")).select(F.explode(F.sequence(F.trunc("a", "quarter"), "z", F.expr("interval 3 months"))).alias("q"))
    r = days.select("q", F.explode(F.array(*[F.lit(e) for e in ob.ENDPOINTS])).alias("endpoint"))
    r = r.where("NOT (endpoint = 'dividends' AND q = DATE '1997-07-01')")
    end = F.last_day(F.add_months("q", F.when(F.month("q") == 1, 4).otherwise(2)))
    at = F.when((F.col("endpoint") == "dividends") & (F.col("q") == F.lit("1996-07-01").cast("date")), F.col("q") + F.expr("INTERVAL 400 DAYS")).otherwise(F.lit("1995-01-01").cast("timestamp"))
    return r.select("endpoint", F.col("q").alias("actions_start"), end.alias("actions_end"), at.cast("timestamp").alias("retrieved_at"), F.sha2(F.concat("endpoint", F.col("q").cast("string")), 256).alias("content_hash"), F.concat_ws("-", "endpoint", "q").alias("request_id"))


@view("observed", f"""
WITH a AS MATERIALIZED (SELECT t.ticker, t.session_date, t.adjusted_close AS close, t.dividends_clean, m.median_dollar_volume_20d, row_number() OVER (PARTITION BY t.ticker ORDER BY t.session_date)-1 AS prior_sessions
 FROM total_return t JOIN (SELECT ticker, session_date, CASE WHEN count(*) OVER w = 20 THEN median(coalesce(close,0)*coalesce(volume,0)) OVER w END AS median_dollar_volume_20d FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) m
 ON m.ticker = t.ticker AND m.session_date = t.session_date),
b AS MATERIALIZED (SELECT a.*, r.exchange AS exchange_mic, CASE r.raw_type WHEN 'CS' THEN 'common_stock' WHEN 'ADRC' THEN 'adr' END AS security_type, coalesce(r.share_class_figi, r.composite_figi, r.cik) IS NOT NULL AS identity_clean, coalesce(r.share_class_figi, r.composite_figi, r.cik, 'ticker:' || a.ticker) AS security_id,
 dividends_clean AND close IS NOT NULL AS cac, r.currency FROM a ASOF LEFT JOIN listed r ON r.ticker = a.ticker AND a.session_date >= r.snapshot_date),
q AS MATERIALIZED (SELECT *, last_value(bench_close IGNORE NULLS) OVER (ORDER BY session_date, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT session_date, bench_close, NULL AS cash, 1 AS side FROM bench UNION ALL SELECT event_date, NULL, cash, 0 FROM bench_dividends)),
p AS MATERIALIZED (SELECT session_date AS d, side, bench_close, coalesce(product(f) OVER w, 1e0) AS factor, coalesce(max(bad) OVER w, 0) = 0 AS ok FROM (SELECT *, CASE WHEN side = 0 AND prev > cash THEN (prev-cash)/prev END AS f, CASE WHEN side = 0 THEN CASE WHEN prev > cash THEN 0 ELSE 1 END END AS bad FROM q)
 WINDOW w AS (ORDER BY session_date, side ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
e AS MATERIALIZED (SELECT d, CASE WHEN ok THEN bench_close*factor END AS bench_close, ok FROM p WHERE side = 1),
c AS MATERIALIZED (SELECT d, bench_close, ok, lead(d,1) OVER w AS t1, lead(d,5) OVER w AS t5, lead(bench_close,1) OVER w AS b1, lead(bench_close,5) OVER w AS b5, lead(ok,1) OVER w AS k1, lead(ok,5) OVER w AS k5 FROM e WINDOW w AS (ORDER BY d))
SELECT b.*, c.bench_close, c.b1, c.b5, x.close AS p1, x.dividends_clean AND c.ok AND c.k1 AS c1, y.close AS p5, y.dividends_clean AND c.ok AND c.k5 AS c5, 'unknown' AS eligibility, n.event_date IS NOT NULL AS dividend_on_session FROM b JOIN c ON c.d = b.session_date
 LEFT JOIN a x ON x.ticker = b.ticker AND x.session_date = c.t1 LEFT JOIN a y ON y.ticker = b.ticker AND y.session_date = c.t5 LEFT JOIN (SELECT DISTINCT ticker, event_date FROM dividends) n ON n.ticker = b.ticker AND n.event_date = b.session_date""")
def _observed(v):
    return ob.build_observations(v.bars, v.listed, v.dividends, v.bench, v.splits, coverage=v.action_requests.where("NOT (endpoint = 'dividends' AND year(actions_start) = 1994)").unionByName(
        v.action_requests.where("endpoint = 'splits' AND actions_start = DATE '1997-07-01'").withColumn("endpoint", F.lit("dividends"))), bench_dividends=v.bench_dividends)


OBS = KEY + "security_id:s security_type:s adjusted_close:f bench_close:f median_dollar_volume_20d:f4 prior_sessions:l corporate_actions_clean:b eligibility:s label_status_1:s excess_1:f direction_1:s label_status_5:s excess_5:f direction_5:s dividend_on_session:b"


@query("build_observations", OBS, f"SELECT *, close AS adjusted_close, cac AS corporate_actions_clean, {_lab(1)}, {_lab(5)} FROM observed")
def _(v):
    d = v.observed
    for n in (1, 5):
        d = d.withColumns({f"label_status_{n}": F.col(f"label_{n}.status"), f"excess_{n}": F.col(f"label_{n}.excess"), f"direction_{n}": F.col(f"label_{n}.direction")})
    return d


@query("forward_labels", KEY + "label_status_1:s excess_1:f direction_1:s label_status_5:s excess_5:f direction_5:s", f"""
SELECT ticker, session_date, {_lab(1)}, {_lab(5)} FROM (SELECT t.ticker, t.session_date, t.close, t.clean AS cac, b.bench_close, x.close AS p1, x.clean AS c1, b1.bench_close AS b1, y.close AS p5, y.clean AS c5, b5.bench_close AS b5
 FROM targets t JOIN bench b ON b.session_date = t.session_date LEFT JOIN bars x ON x.ticker = t.ticker AND x.session_date = t.target_1 LEFT JOIN bars y ON y.ticker = t.ticker AND y.session_date = t.target_5
 LEFT JOIN bench b1 ON b1.session_date = t.target_1 LEFT JOIN bench b5 ON b5.session_date = t.target_5)""")
def _(v):
    d = v.targets.join(v.bench, "session_date")
    for n in (1, 5):
        d = (d.join(v.bench.withColumnsRenamed({"session_date": f"target_{n}", "bench_close": f"b{n}"}), f"target_{n}", "left")
             .join(v.bars.select("ticker", F.col("session_date").alias(f"target_{n}"), F.col("clean").alias(f"c{n}")), ["ticker", f"target_{n}"], "left"))
        lab = ob.forward_label(F.col("close"), F.col(f"close_t{n}"), F.col("bench_close"), F.col(f"b{n}"), n, F.col("clean") & F.col(f"c{n}"))
        d = d.withColumn("_l", lab).withColumns({f"label_status_{n}": F.col("_l.status"), f"excess_{n}": F.col("_l.excess"), f"direction_{n}": F.col("_l.direction")}).drop("_l")
    return d


# --- archive checks --------------------------------------------------------------------------------------------------

@query("archive_status", "status:s sessions:l no_data:l bars:l symbols:l first_session:d last_session:d", """
SELECT 'ready' AS status, (SELECT count(*) FROM calendar_log WHERE status='complete') AS sessions, (SELECT count(*) FROM calendar_log WHERE status='no_data') AS no_data, count(*) AS bars, count(DISTINCT ticker) AS symbols, min(session_date) AS first_session, max(session_date) AS last_session FROM bars""")
def _(v):
    return ob.archive_status(v.calendar_log, v.bars)


@query("duplicate_keys", "l_orderkey:l l_linenumber:l n:l", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return ob.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("archive_validate", "missing_weekdays:l bad_bars:l duplicate_keys:l completed:l bars:l observations:l why:s status:s", """
SELECT mw AS missing_weekdays, bb AS bad_bars, 0 AS duplicate_keys, c AS completed, b AS bars, o AS observations, array_to_string(list_filter([CASE WHEN mw > 0 THEN 'missing weekdays' END, CASE WHEN bb > 0 THEN 'bad bars' END, CASE WHEN c = 0 THEN 'no populated sessions' END, CASE WHEN b > 0 AND o <> b THEN 'observations incomplete' END], lambda x: x IS NOT NULL), ';') AS why,
 CASE WHEN mw + bb = 0 AND c > 0 AND o = b THEN 'valid' ELSE 'incomplete' END AS status FROM (SELECT
 (SELECT count(*) FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT session_date FROM calendar_log)) AS mw,
 (SELECT count(*) FROM raw_bars WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND (close IS NULL OR close <= 0 OR h2 < low OR v2 < 0 OR NOT adjusted)) AS bb,
 (SELECT count(*) FROM calendar_log WHERE status='complete' AND session_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS c, (SELECT count(*) FROM bars WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS b,
 (SELECT count(*) FROM hist WHERE clean AND session_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS o)""")
def _(v):
    r = ob.archive_validate(v.calendar_log, _with_raw(v), v.hist.filter("clean"), "1996-01-01", "1999-12-31")
    return r.withColumn("why", F.array_join("problems", ";"))


def _hash(*cols):
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)


@view("certified", """
SELECT *, CASE WHEN why = '' THEN 'ready' ELSE 'blocked' END AS status FROM (SELECT session_date, members, lacking_close, lacking_reference, lacking_identifier, array_to_string(list_filter([CASE WHEN st <> 'complete' THEN 'session missing or incomplete' END,
 CASE WHEN session_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30' OR session_date BETWEEN DATE '1996-07-01' AND DATE '1996-09-30' THEN 'action coverage' END,
 CASE WHEN lacking_close > 0 THEN 'close' END, CASE WHEN lacking_reference > 0 THEN 'reference' END, CASE WHEN lacking_identifier > 0 THEN 'identifier' END], lambda x: x IS NOT NULL), ';') AS why FROM (
SELECT a.session_date, any_value(l.status) AS st, count(*) AS members, count(*) FILTER (WHERE bad) AS lacking_close, count(*) FILTER (WHERE NOT bad AND r.ticker IS NULL) AS lacking_reference,
 count(*) FILTER (WHERE NOT bad AND r.ticker IS NOT NULL AND coalesce(r.share_class_figi, r.composite_figi, r.cik) IS NULL) AS lacking_identifier
FROM (SELECT *, day(session_date) = 29 OR trades = 9 AS bad FROM raw_bars) a ASOF LEFT JOIN listed r ON r.ticker = a.ticker AND a.session_date >= r.snapshot_date JOIN calendar_log l ON l.session_date = a.session_date GROUP BY 1))""")
def _certified(v):
    asks, b, refs, sessions = _certifying(v)
    return ob.certify_sessions(asks, b, refs, sessions, v.action_requests).withColumn("why", F.array_join("failures", ";"))


def _certifying(v):
    day = F.col("session_date").cast("timestamp")
    b = v.raw_bars.withColumn("fetched_at", F.when(F.col("trades") == 9, F.timestamp_add("HOUR", F.lit(30), day)).otherwise(F.timestamp_add("HOUR", F.lit(21), day))).withColumn("raw_sha256", _hash("ticker", "session_date"))
    refs = v.listed.withColumn("raw_sha256", _hash("ticker", "snapshot_date"))
    sessions = v.calendar_log.withColumn("adjusted", F.lit(True)).withColumn("fetched_at", F.timestamp_add("HOUR", F.lit(21), day))
    return v.raw_bars.select("ticker", "session_date", F.timestamp_add("HOUR", F.lit(22), day).alias("cutoff")), b, refs, sessions


@query("certify_session", "session_date:d members:l lacking_close:l lacking_reference:l lacking_identifier:l status:s why:s", "SELECT * FROM certified")
def _(v):
    return v.certified


@query("certified_members", "session_date:d ticker:s security_id:s active:b", """
SELECT a.session_date, a.ticker, CASE WHEN share_class_figi IS NOT NULL THEN 'FIGI:' || share_class_figi WHEN composite_figi IS NOT NULL THEN 'FIGI:' || composite_figi ELSE 'CIK:' || cik END AS security_id, active
FROM (SELECT DISTINCT ticker, session_date FROM raw_bars) a JOIN certified c ON c.session_date = a.session_date AND c.status = 'ready' ASOF JOIN listed r ON r.ticker = a.ticker AND a.session_date >= r.snapshot_date""")
def _(v):
    asks, b, refs, _ = _certifying(v)
    return ob.certified_members(asks, b, refs, v.certified)


@query("certified_evidence", "category:s session_date:d n:l", """
SELECT 'archived_adjusted_close' AS category, session_date, members AS n FROM certified WHERE status = 'ready' UNION ALL SELECT 'corporate_action_coverage', session_date, 2 FROM certified WHERE status = 'ready'""")
def _(v):
    asks, b, refs, _ = _certifying(v)
    rows = ob.certified_evidence(asks, b, refs, v.certified)
    return rows.groupBy("category", "session_date").agg(F.sum(F.size("content_hashes")).alias("n"))


@query("action_coverage", "endpoint:s actions_start:d actions_end:d", """
WITH r AS (SELECT e AS endpoint, CAST(q AS DATE) AS s, CAST(last_day(CAST(q AS DATE) + to_months(CASE WHEN month(q) = 1 THEN 4 ELSE 2 END)) AS DATE) AS z FROM (SELECT unnest(generate_series(date_trunc('quarter', min(session_date)), max(session_date) + INTERVAL 30 DAY, INTERVAL 3 MONTH)) AS q FROM bench), (SELECT unnest(['splits', 'dividends']) AS e)
 WHERE NOT (e = 'dividends' AND q = DATE '1997-07-01')),
m AS (SELECT *, max(z) OVER (PARTITION BY endpoint ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
n AS (SELECT *, sum(CASE WHEN reached IS NULL OR s - reached > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY s) AS island FROM m)
SELECT endpoint, min(s) AS actions_start, max(z) AS actions_end FROM n GROUP BY endpoint, island""")
def _(v):
    return intervals.interval_union(v.action_requests, ["endpoint"], "actions_start", "actions_end")


# --- cross-source ----------------------------------------------------------------------------------------------------

@view("checks", """
SELECT *, CASE WHEN matched = 0 THEN 'unavailable' WHEN max_difference > 3 THEN 'conflict' WHEN coverage >= 80 AND all_close AND current_matched THEN 'verified' ELSE 'review' END AS status FROM (
SELECT ticker AS symbol, count(*) AS required, count(d) AS matched, max(d) AS max_difference, count(d)*100e0/count(*) AS coverage, count(*) FILTER (WHERE d <= 1) = count(d) AS all_close, arg_max(d IS NOT NULL, session_date) AS current_matched
FROM (SELECT ticker, session_date, CASE WHEN (CAST(ticker AS BIGINT) + day(session_date)) % 12 <> 0 THEN abs(close/(close*(1e0 + CASE WHEN CAST(ticker AS BIGINT) % 9 = 0 AND trades > 3 THEN 0.04e0 WHEN CAST(ticker AS BIGINT) % 7 = 0 THEN 0.02e0 ELSE 0.001e0 END))-1)*100 END AS d FROM bars) GROUP BY 1)""")
def _checks(v):
    k = F.col("ticker").cast("bigint")
    off = 1.0 + F.when((k % 9 == 0) & (F.col("trades") > 3), 0.04).when(k % 7 == 0, 0.02).otherwise(0.001)
    other = v.bars.filter((k + F.day("session_date")) % 12 != 0).select(F.col("ticker").alias("symbol"), F.col("session_date").alias("date"), (F.col("close") * off).alias("close"))
    primary = v.bars.select(F.col("ticker").alias("symbol"), F.col("session_date").alias("date"), F.col("close").alias("price"))
    return ob.crosscheck(primary, other)


@query("price_crosscheck", "symbol:s required:l matched:l max_difference:f coverage:f all_close:b current_matched:b status:s", "SELECT * FROM checks")
def _(v):
    return v.checks


@query("source_crosscheck_join", "symbol:s required:l matched:l", "SELECT symbol, required, matched FROM checks")
def _(v):
    return v.checks


@query("unexplained_jumps", KEY + "jump_ratio:f", """
SELECT * FROM (SELECT ticker, session_date, greatest(close/lag(close) OVER w, lag(close) OVER w/close) AS jump_ratio FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session_date)) j
WHERE jump_ratio >= 2.2e0 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ticker = j.ticker AND abs(s.split_date - j.session_date) <= 10)""")
def _(v):
    return joins.unexplained_jumps(v.bars, v.splits, 2.2, 10)


@query("market_integrity", "symbol:s fresh:b price_checked:b identity_resolved:b actions_clean:b rating_ready:b status:s", """
SELECT *, fresh AND price_checked AND identity_resolved AND actions_clean AS rating_ready, CASE WHEN last IS NULL THEN 'unavailable' WHEN fresh AND price_checked AND identity_resolved AND actions_clean THEN 'ready' WHEN NOT fresh THEN 'stale' ELSE 'review' END AS status FROM (
SELECT k.ticker AS symbol, l.last, coalesce((SELECT max(session_date) FROM bars) - l.last BETWEEN 0 AND 4, false) AS fresh, coalesce(c.status = 'verified', false) AS price_checked, CAST(k.ticker AS BIGINT) % 5 <> 0 AS identity_resolved, j.ticker IS NULL AS actions_clean
FROM kinds k LEFT JOIN (SELECT ticker, max(session_date) AS last FROM bars GROUP BY 1) l ON l.ticker = k.ticker LEFT JOIN checks c ON c.symbol = k.ticker LEFT JOIN (SELECT DISTINCT ticker FROM (SELECT ticker, session_date, greatest(close/lag(close) OVER w, lag(close) OVER w/close) AS q FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session_date)) b
 WHERE q >= 2.9e0 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ticker = b.ticker AND abs(s.split_date - b.session_date) <= 3)) j ON j.ticker = k.ticker)""")
def _(v):
    ids = v.kinds.select(F.col("ticker").alias("symbol"), F.when(F.col("ticker").cast("bigint") % 5 != 0, "resolved").otherwise("ambiguous").alias("status"))
    today = v.bars.agg(F.max("session_date")).scalar()
    jumps = joins.unexplained_jumps(v.bars, v.splits, 2.9)
    return ob.integrity(v.kinds.select(F.col("ticker").alias("symbol")), latest_close(v.bars), v.checks, ids, jumps, today)


@view("covered", "SELECT source AS area, count(*) AS total, count(*) FILTER (WHERE n_chars > 200) AS ready, count(*) FILTER (WHERE n_chars > 200)*100e0/count(*) AS share FROM documents GROUP BY 1")
def _covered(v):
    return ob.evidence_coverage(v.table("documents").withColumnRenamed("source", "area"), "area", F.col("n_chars") > 200)


@query("evidence_coverage", "area:s total:l ready:l share:f", "SELECT * FROM covered")
def _(v):
    return v.covered


@query("evidence_policy_gate", "areas:l complete:l next_upgrade:s ceiling:s", """
SELECT count(*) AS areas, count(*) FILTER (WHERE share >= 90) AS complete, arg_min(area, (share, area)) AS next_upgrade, CASE WHEN count(*) FILTER (WHERE share >= 90) = count(*) THEN 'High' WHEN count(*) FILTER (WHERE share >= 90)*2 >= count(*) THEN 'Medium' ELSE 'Low' END AS ceiling FROM covered""")
def _(v):
    return ob.evidence_gate(v.covered, "area", 90.0)


# --- snapshots and audit ---------------------------------------------------------------------------------------------

@view("frozen", """
SELECT l_orderkey AS snapshot_id, CASE WHEN l_suppkey % 11 <> 0 THEN 'CIK:' || l_suppkey END AS security_id, CAST(l_suppkey AS VARCHAR) AS ticker, CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag <> 'N' END AS active,
 CASE WHEN l_linestatus = 'F' THEN 'verified' WHEN l_suppkey % 2 = 0 THEN 'resolved' ELSE 'open' END AS identity_status, l_suppkey % 17 <> 0 AS included,
 l_linenumber % 5 <> 0 AS membership_verified, CAST(min(l_shipdate) AS TIMESTAMP) AS identity_available_at, TIMESTAMP '2000-01-01' AS cutoff FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber""")
def _frozen(v):
    s = F.col("l_suppkey")
    return v.table("lineitem").groupBy("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.min(F.col("l_shipdate").cast("timestamp")).alias("identity_available_at")).select(
        F.col("l_orderkey").alias("snapshot_id"), F.when(s % 11 != 0, F.concat(F.lit("CIK:"), s.cast("string"))).alias("security_id"), s.cast("string").alias("ticker"), F.when(s % 13 != 0, F.col("l_returnflag") != "N").alias("active"),
        F.when(F.col("l_linestatus") == "F", "verified").when(s % 2 == 0, "resolved").otherwise("open").alias("identity_status"), (s % 17 != 0).alias("included"), (F.col("l_linenumber") % 5 != 0).alias("membership_verified"), "identity_available_at",
        F.lit("2000-01-01").cast("timestamp").alias("cutoff"))


@view("evid", "SELECT o_orderkey AS snapshot_id, 'CIK:' || o_custkey AS security_id, o_orderpriority AS payload, CAST(o_orderdate AS TIMESTAMP) AS available_at, TIMESTAMP '2000-01-01' AS cutoff FROM orders")
def _evid(v):
    return v.table("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("CIK:"), F.col("o_custkey").cast("string")).alias("security_id"), F.col("o_orderpriority").alias("payload"),
                                    F.col("o_orderdate").cast("timestamp").alias("available_at"), F.lit("2000-01-01").cast("timestamp").alias("cutoff"))


_ROOT = "sha256(concat_ws(chr(31), CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(digest, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)) + "))"
_WHY = """nullif(concat_ws('; ', CASE WHEN security_id IS NULL THEN 'no stable identifier' END, CASE WHEN security_id IS NULL OR identity_status = 'open' THEN 'identity not verified' END,
 CASE WHEN active IS NULL THEN 'activity unknown' END, CASE WHEN NOT membership_verified OR identity_available_at > cutoff THEN 'membership not verified' END,
 CASE WHEN identity_available_at > cutoff THEN 'identity after cutoff' END, CASE WHEN NOT included THEN 'not selected' END), '')"""


@view("manifests", f"""
SELECT *, {canon('snapshot_id', 'members', 'members_root', 'evidence', 'evidence_root')} AS manifest_hash FROM (SELECT m.snapshot_id, members, members_root, included, coalesce(evidence, 0) AS evidence, evidence_root, coalesce(late_evidence, 0) AS late_evidence, CASE WHEN late_evidence > 0 THEN 'refused' ELSE 'captured' END AS status FROM (
 SELECT snapshot_id, count(*) AS members, count(*) FILTER (WHERE included) AS included, {_ROOT} AS members_root FROM (SELECT *, {canon('snapshot_id', 'security_id', 'ticker', 'included', 'exclusion')} AS digest FROM (SELECT * EXCLUDE (included), exclusion IS NULL AS included FROM (SELECT *, {_WHY} AS exclusion FROM frozen))) GROUP BY 1) m
 LEFT JOIN (SELECT snapshot_id, count(*) AS evidence, {_ROOT} AS evidence_root FROM (SELECT *, {canon('snapshot_id', 'security_id', 'payload')} AS digest FROM evid WHERE available_at <= cutoff) GROUP BY 1) e ON e.snapshot_id = m.snapshot_id
 LEFT JOIN (SELECT snapshot_id, count(*) AS late_evidence FROM evid WHERE available_at > cutoff GROUP BY 1) x ON x.snapshot_id = m.snapshot_id)""")
def _manifests(v):
    return lg.capture_snapshot(v.frozen, v.evid)


@query("capture_snapshot", "snapshot_id:l members:l included:l evidence:l late_evidence:l status:s members_root:s manifest_hash:s", "SELECT * FROM manifests")
def _(v):
    return v.manifests


@query("snapshot_conflicts", "snapshot_id:l", "SELECT snapshot_id FROM manifests WHERE snapshot_id % 50 = 0")
def _(v):
    stored = v.manifests.withColumn("manifest_hash", F.when(F.col("snapshot_id") % 50 == 0, F.lit("0" * 64)).otherwise(F.col("manifest_hash")))
    return lg.snapshot_conflicts(v.manifests, stored)


@query("audit_hashes", "doc_id:l recomputed:s", f"SELECT doc_id, {canon('doc_id', 'lang', 'source', 'text')} AS recomputed FROM documents WHERE doc_id % 13 = 0")
def _(v):
    d = v.table("documents")
    broken = F.col("doc_id") % 13 == 0
    stored = d.withColumn("digest", F.when(broken, F.lit("f" * 64)).otherwise(content_address("doc_id", "lang", "source", "text")))
    return lg.audit_hashes(stored, ["doc_id", "lang", "source", "text"], "digest", ["doc_id"])


@query("reconstruct", "rows:l root:s orphans:l", f"""
SELECT count(*) AS rows, {_ROOT} AS root, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS orphans FROM (SELECT {canon('doc_id', 'lang', 'source', 'text')} AS digest FROM documents)""")
def _(v):
    d = v.table("documents")
    root = lg.logical_root(d.withColumn("digest", content_address("doc_id", "lang", "source", "text")), "digest")
    lost = lg.orphans(v.table("labels"), d.filter("doc_id % 3 <> 0"), ["doc_id"]).agg(F.count(F.lit(1)).alias("orphans"))
    return root.withColumn("orphans", lost.scalar())


@query("ledger_counts", "name:s n:l", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def _(v):
    return lg.ledger_counts({t: v.table(t) for t in ("orders", "lineitem", "events")})


# --- outcomes --------------------------------------------------------------------------------------------------------

@view("oc_cal", "SELECT session_date, row_number() OVER (ORDER BY session_date)-1 AS ordinal, bench_close FROM bench")
def _oc_cal(v):
    return reliable_checkpoint(joins.calendar_ordinal(v.bench).join(v.bench, "session_date"))


@view("oc_obs", """
SELECT 'CIK:' || k.ticker AS security_id, CASE WHEN CAST(k.ticker AS BIGINT) % 17 = 3 AND c.ordinal % 701 = 5 THEN unnest([k.ticker, 'X' || k.ticker]) ELSE k.ticker END AS ticker, c.session_date, c.bench_close*(1e0 + (CAST(k.ticker AS BIGINT) % 10)/10e0) AS adjusted_close, true AS clean,
 CAST(c.session_date AS TIMESTAMP) + INTERVAL 21 HOUR AS retrieved_at FROM oc_cal c, kinds k WHERE (CAST(k.ticker AS BIGINT) % 4 = 0 OR (CAST(k.ticker AS BIGINT)*31 + c.ordinal) % 397 <> 0) AND (CAST(k.ticker AS BIGINT) % 5 <> 0 OR c.ordinal <= 1500 + CAST(k.ticker AS BIGINT))""")
def _oc_obs(v):
    k, o = F.col("ticker").cast("bigint"), F.col("ordinal")
    # A product and not an exploded list: of a list's length the planner knows nothing, and would broadcast all observations.
    rows = spread(v.kinds.select("ticker")).crossJoin(F.broadcast(v.oc_cal)).filter(((k % 4 == 0) | ((k * 31 + o) % 397 != 0)) & ((k % 5 != 0) | (o <= 1500 + k)))
    twice = (k % 17 == 3) & (o % 701 == 5)
    rows = rows.withColumn("t", F.explode(F.when(twice, F.array(F.col("ticker"), F.concat(F.lit("X"), "ticker"))).otherwise(F.array("ticker"))))
    return rows.select(F.concat(F.lit("CIK:"), "ticker").alias("security_id"), F.col("t").alias("ticker"), "session_date", (F.col("bench_close") * (1.0 + (k % 10) / 10.0)).alias("adjusted_close"), F.lit(True).alias("clean"),
                       F.timestamp_add("HOUR", F.lit(21), F.col("session_date").cast("timestamp")).alias("retrieved_at"))


@view("oc_off", "SELECT 'CIK:' || k.ticker AS security_id, CAST(k.ticker AS BIGINT) AS n, c.session_date AS delisted_on FROM kinds k JOIN oc_cal c ON CAST(k.ticker AS BIGINT) % 5 = 0 AND c.ordinal = 1500 + CAST(k.ticker AS BIGINT)")
def _oc_off(v):
    k = v.kinds.withColumn("n", F.col("ticker").cast("bigint")).filter("n % 5 = 0").withColumn("ordinal", F.col("n") + 1500)
    return k.join(v.oc_cal, "ordinal").select(F.concat(F.lit("CIK:"), "ticker").alias("security_id"), "n", F.col("session_date").alias("delisted_on"))


@view("oc_members", "SELECT o_orderkey AS snapshot_id, 'CIK:' || o_custkey % 100 AS security_id, CAST(o_orderdate AS DATE) AS decision_date, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'USD' END AS currency FROM orders")
def _oc_members(v):
    return v.table("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("CIK:"), (F.col("o_custkey") % 100).cast("string")).alias("security_id"), F.to_date("o_orderdate").alias("decision_date"),
                                    F.when(F.col("o_orderkey") % 29 != 0, "USD").alias("currency"))


_OCR = "2001-06-30 23:00:00"


@view("oc_facts", f"""
SELECT m.*, f.delisted_on, CASE f.n % 15 WHEN 0 THEN 'cash' WHEN 5 THEN 'stock' ELSE 'mixed' END AS kind, f.n, f.n IS NOT NULL AND f.n % 20 <> 15 AS has_event, CASE WHEN f.n % 35 = 0 AND f.n > 0 THEN f.delisted_on + 1 ELSE f.delisted_on END AS effective_on,
 (SELECT min(session_date) FROM oc_cal c WHERE c.session_date > m.decision_date AND c.session_date <= DATE '2001-06-30') AS d0, least(coalesce(f.delisted_on, l.last), l.last) AS dend, l.last,
 (SELECT min(session_date) FROM oc_cal c WHERE c.session_date >= greatest(m.decision_date + 365, coalesce(f.delisted_on + 1, m.decision_date)) AND c.session_date <= DATE '2001-06-30') AS due
FROM oc_members m LEFT JOIN oc_off f ON f.security_id = m.security_id, (SELECT max(session_date) AS last FROM oc_cal WHERE session_date <= DATE '2001-06-30') l""")
def _oc_facts(v):
    return v.oc_members


@view("oc_days", "SELECT security_id, session_date, count(DISTINCT ticker) AS nt, max(adjusted_close) AS close FROM oc_obs WHERE session_date <= DATE '2001-06-30' GROUP BY 1, 2")
def _oc_days(v):
    return v.oc_obs


@view("oc_result", f"""
SELECT *, CASE WHEN reason LIKE 'conflict%' THEN 'conflict' WHEN reason IS NOT NULL THEN 'missing' WHEN delisted_on IS NOT NULL AND has_event THEN 'delisted_complete' WHEN last >= decision_date + 365 THEN 'complete' ELSE 'pending' END AS status FROM (
SELECT *, CASE WHEN currency IS NULL OR no_ref THEN 'missing: listing currency' WHEN c0 IS NOT NULL AND clash > 0 THEN 'conflict: two tickers' WHEN c0 IS NULL THEN 'missing: entry' WHEN delisted_on IS NOT NULL AND (NOT has_event OR effective_on <> delisted_on) THEN 'missing: proceeds'
 WHEN seen <> need THEN 'missing: sessions' WHEN delisted_on IS NOT NULL AND kind <> 'cash' AND NOT coalesce(sc IS NOT NULL AND sseen = sneed, false) THEN 'missing: successor path' END AS reason FROM (
SELECT f.*, false AS no_ref, a.close AS c0, b.close AS c1, s.close AS sc,
 (SELECT count(*) FROM oc_days d WHERE d.security_id = f.security_id AND d.session_date > f.d0 AND d.session_date <= f.dend AND nt > 1) AS clash, (SELECT count(*) FROM oc_days d WHERE d.security_id = f.security_id AND d.session_date BETWEEN f.d0 AND f.dend) AS seen,
 (SELECT count(*) FROM oc_cal c WHERE c.session_date BETWEEN f.d0 AND f.dend) AS need, (SELECT count(*) FROM oc_days d WHERE d.security_id = 'CIK:' || (f.n+1) AND d.session_date > f.dend AND d.session_date <= f.due) AS sseen, (SELECT count(*) FROM oc_cal c WHERE c.session_date > f.dend AND c.session_date <= f.due) AS sneed
FROM oc_facts f LEFT JOIN oc_days a ON a.security_id = f.security_id AND a.session_date = f.d0 LEFT JOIN oc_days b ON b.security_id = f.security_id AND b.session_date = f.dend LEFT JOIN oc_days s ON s.security_id = 'CIK:' || (f.n+1) AND s.session_date = f.due))""")
def _oc_result(v):
    return lg.capture_outcomes(*_outcome_inputs(v))


def _outcome_inputs(v):
    recorded = F.lit(_OCR).cast("timestamp")
    off, t0 = v.oc_off, F.lit("1995-01-01").cast("timestamp")
    ids = v.oc_members.select("security_id").distinct()
    refs = ids.join(off, "security_id", "left").select("security_id", F.lit("USD").alias("currency"), F.col("delisted_on").isNull().alias("active"), "delisted_on", t0.alias("retrieved_at"))
    sessions = v.oc_cal.select("session_date", F.lit("complete").alias("status"), F.timestamp_add("HOUR", F.lit(21), F.col("session_date").cast("timestamp")).alias("fetched_at"))
    n = F.col("n")
    kind = F.when(n % 15 == 0, "cash").when(n % 15 == 5, "stock").otherwise("mixed")
    ev = off.filter(n % 20 != 15).select(
        "security_id", n.cast("string").alias("accession"), F.when((n % 35 == 0) & (n > 0), F.date_add("delisted_on", 1)).otherwise(F.col("delisted_on")).alias("effective_on"), kind.alias("kind"),
        F.when(kind != "stock", 50.0 + n).alias("cash"), F.when(kind != "stock", "USD").alias("currency"), F.when(kind != "cash", 0.5).alias("ratio"), F.when(kind != "cash", F.concat(F.lit("CIK:"), (n + 1).cast("string"))).alias("successor_id"),
        F.lit(None).cast("string").alias("supersedes"), t0.alias("available_at"), t0.alias("retrieved_at"))
    return v.oc_members, refs, sessions, v.oc_obs, ev, recorded


@query("capture_outcomes", "snapshot_id:l security_id:s status:s reason:s total_return:f path_sessions:l", """
SELECT snapshot_id, security_id, status, reason, CASE WHEN status IN ('complete','pending') THEN c1/c0-1 WHEN status = 'delisted_complete' THEN (CASE WHEN kind <> 'stock' THEN 50e0+n ELSE 0 END + CASE WHEN kind <> 'cash' THEN 0.5e0*sc ELSE 0 END)/c0-1 END AS total_return,
 CASE WHEN status IN ('complete','pending','delisted_complete') THEN need END AS path_sessions FROM oc_result""")
def _(v):
    return v.oc_result


@query("capture_renamed_outcomes", "snapshot_id:l security_id:s status:s reason:s total_return:f path_sessions:l", """
SELECT snapshot_id, security_id, CASE WHEN x THEN 'conflict' ELSE status END AS status, CASE WHEN x THEN 'conflict: identity chain' ELSE reason END AS reason, CASE WHEN x THEN NULL WHEN status IN ('complete','pending') THEN c1/c0-1 WHEN status = 'delisted_complete' THEN (CASE WHEN kind <> 'stock' THEN 50e0+n ELSE 0 END + CASE WHEN kind <> 'cash' THEN 0.5e0*sc ELSE 0 END)/c0-1 END AS total_return,
 CASE WHEN NOT x AND status IN ('complete','pending','delisted_complete') THEN need END AS path_sessions FROM (SELECT *, CAST(split_part(security_id, ':', 2) AS BIGINT) % 13 = 1 AS x FROM oc_result)""")
def _(v):
    """The same paths under names that changed twice on the way; every thirteenth name goes round in a circle."""
    members, refs, sessions, observations, events, recorded = _outcome_inputs(v)
    day, number = F.col("session_date"), F.substring_index("security_id", ":", -1).cast("bigint")
    tail = F.when(day > F.lit("1998-06-30").cast("date"), ":c").when(day > F.lit("1997-03-31").cast("date"), ":b").otherwise("")
    renamed = observations.withColumn("security_id", F.when(number % 13 != 1, F.concat("security_id", tail)).otherwise(F.col("security_id")))
    ids = members.select("security_id").unionByName(observations.select("security_id")).distinct()
    at = F.lit("1995-01-01").cast("timestamp").alias("retrieved_at")
    b, c = F.concat("security_id", F.lit(":b")), F.concat("security_id", F.lit(":c"))
    steady, circle = ids.where(number % 13 != 1), ids.where(number % 13 == 1)
    renames = steady.select(F.col("security_id").alias("old_id"), b.alias("new_id"), at).unionByName(steady.select(b.alias("old_id"), c.alias("new_id"), at)).unionByName(circle.select(F.col("security_id").alias("old_id"), b.alias("new_id"), at)).unionByName(circle.select(b.alias("old_id"), F.col("security_id").alias("new_id"), at))
    return lg.capture_renamed_outcomes(members, refs, sessions, renamed, events, recorded, renames)


@query("outcome_states", "status:s members:l", "SELECT status, count(*) AS members FROM oc_result GROUP BY 1")
def _(v):
    o = v.oc_result.withColumn("recorded_at", F.lit(_OCR).cast("timestamp")).withColumn("outcome_id", F.col("snapshot_id"))
    return lg.outcome_states(o)


@view("oc_new", """
SELECT o_orderkey AS snapshot_id, 'CIK:' || o_custkey AS security_id, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'complete' END AS status, CAST(o_orderdate AS DATE) + 365 AS valid_through, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS source_hash,
 CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS effective_at, CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 900 AS INTEGER) * INTERVAL 1 DAY AS available_at, CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 880 AS INTEGER) * INTERVAL 1 DAY AS retrieved_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 700 DAY AS recorded_at, o_orderkey AS k FROM orders""")
def _oc_new(v):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = lambda n: F.timestamp_add("DAY", n.cast("int") if not isinstance(n, int) else F.lit(n), d)
    return v.table("orders").select(k.alias("snapshot_id"), F.concat(F.lit("CIK:"), F.col("o_custkey").cast("string")).alias("security_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("complete").alias("status"),
                                    F.date_add(F.to_date(d), 365).alias("valid_through"), F.when(k % 17 == 0, "bad").otherwise(F.sha2(k.cast("string"), 256)).alias("source_hash"), day(1).alias("effective_at"), day(k % 900).alias("available_at"),
                                    day(k % 880).alias("retrieved_at"), day(700).alias("recorded_at"), k.alias("k"))


_PROB = _list([("greatest(available_at, retrieved_at) > recorded_at", "late evidence"), ("available_at > retrieved_at", "retrieved before available"), ("source_hash = 'bad'", "source hash"), ("k % 19 = 0", "not a frozen member")])


@query("append_outcome", "snapshot_id:l verdict:s why:s outcome_id:s", f"""
SELECT snapshot_id, CASE WHEN len(p) > 0 THEN 'invalid' WHEN k % 7 = 0 THEN 'unchanged' ELSE 'recorded' END AS verdict, array_to_string(p, ';') AS why, {canon('snapshot_id', 'security_id', 'status', 'valid_through', 'source_hash', 'effective_at', 'available_at', 'retrieved_at', 'recorded_at')} AS outcome_id
FROM (SELECT *, {_PROB} AS p FROM oc_new)""")
def _(v):
    r = lg.append_outcomes(v.oc_new, v.oc_new.filter("k % 7 = 0"), v.oc_new.filter("k % 19 <> 0"))
    return r.withColumn("why", F.array_join("problems", ";"))


@query("build_protocol", "snapshot_id:l members:l outcomes_complete:l survivorship_free:b required_through:d status:s", """
SELECT snapshot_id, count(*) AS members, count(*) FILTER (WHERE done) AS outcomes_complete, bool_and(done AND included AND membership_verified) AS survivorship_free, max(req) AS required_through,
 CASE WHEN bool_and(done AND included AND membership_verified) AND bool_and(frozen) THEN 'ready' ELSE 'accumulating' END AS status FROM (
SELECT f.snapshot_id, true AS membership_verified, l.l_linenumber % 50 <> 49 AS included, s.frozen, s.req, coalesce(l.l_returnflag <> 'N' AND ((l.l_returnflag = 'R' AND l.l_suppkey % 2 = 0) OR CAST(l.l_shipdate AS DATE) + 3000 >= s.req), false) AS done FROM (SELECT DISTINCT l_orderkey AS snapshot_id FROM lineitem) f
JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, coalesce(CAST(o_orderdate AS DATE) > max(CASE WHEN o_orderkey % 4 = 3 AND o_orderdate < DATE '1998-01-01' THEN CAST(o_orderdate AS DATE) END) OVER (PARTITION BY o_orderkey % 4), true) AS frozen, greatest(CAST(o_orderdate AS DATE) + 365, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderkey % 4)) AS req FROM orders) s ON s.o_orderkey = f.snapshot_id
JOIN (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber, arg_max(l_returnflag, (l_shipdate, l_partkey)) AS l_returnflag, arg_max(l_shipdate, (l_shipdate, l_partkey)) AS l_shipdate FROM lineitem GROUP BY 1, 2) l ON l.l_orderkey = f.snapshot_id) GROUP BY 1""")
def _(v):
    li = v.table("lineitem")
    members = li.groupBy(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("security_id")).agg((F.min("l_linenumber") % 50 != 49).alias("included"), F.lit(True).alias("membership_verified"))
    flag = F.col("l_returnflag")
    outcomes = li.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("security_id"), F.when(flag == "N", "pending").when(flag == "R", "delisted_complete").otherwise("complete").alias("status"),
                         F.date_add(F.to_date("l_shipdate"), 3000).alias("valid_through"), F.when((flag == "R") & (F.col("l_suppkey") % 2 == 0), "cash").otherwise("stock").alias("kind"), F.lit("USD").alias("currency"),
                         F.col("l_shipdate").alias("recorded_at"), F.col("l_partkey").alias("outcome_id"))
    k = F.col("o_orderkey")
    snaps = v.table("orders").select(k.alias("snapshot_id"), F.to_date("o_orderdate").alias("decision_date"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("policy"), ((k % 4 != 3) | (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).alias("policy_frozen"), F.lit(True).alias("prices_point_in_time"))
    return lg.build_protocol(members, outcomes, snaps)


# --- fund evidence ---------------------------------------------------------------------------------------------------

@query("build_lookthrough", "fund:s cutoff:t report_id:l fee_id:l reporting_lag:l holdings_complete:b complete:b", """
WITH h AS (SELECT * FROM (SELECT c.fund, c.cutoff, r.report_id, r.as_of, r.available, row_number() OVER (PARTITION BY c.fund, c.cutoff ORDER BY r.as_of DESC, r.available DESC, r.retrieved DESC, r.report_id DESC) AS rn FROM cutoffs c JOIN reports r ON r.fund = c.fund AND r.available <= c.cutoff AND r.retrieved <= c.cutoff WHERE r.report_id % 3 <> 0) WHERE rn = 1),
f AS (SELECT * FROM (SELECT c.fund, c.cutoff, r.report_id AS fee_id, row_number() OVER (PARTITION BY c.fund, c.cutoff ORDER BY r.as_of DESC, r.available DESC, r.retrieved DESC, r.report_id DESC) AS rn FROM cutoffs c JOIN reports r ON r.fund = c.fund AND r.available <= c.cutoff AND r.retrieved <= c.cutoff WHERE r.report_id % 11 = 0) WHERE rn = 1)
SELECT c.fund, c.cutoff, h.report_id, f.fee_id, CAST(h.available AS DATE) - h.as_of AS reporting_lag, coalesce(h.report_id % 5 <> 0 AND 90 + h.report_id % 20 BETWEEN 95 AND 105 AND CAST(h.available AS DATE) - h.as_of <= 30, false) AS holdings_complete,
 coalesce(h.report_id % 5 <> 0 AND 90 + h.report_id % 20 BETWEEN 95 AND 105 AND CAST(h.available AS DATE) - h.as_of <= 30, false) AND f.fee_id IS NOT NULL AS complete FROM cutoffs c LEFT JOIN h ON h.fund = c.fund AND h.cutoff = c.cutoff LEFT JOIN f ON f.fund = c.fund AND f.cutoff = c.cutoff""")
def _(v):
    k = F.col("report_id")
    h = v.reports.filter(k % 3 != 0).withColumn("total", (90 + k % 20).cast("double")).withColumn("covered", k % 5 != 0).withColumn("resolved", F.lit(True))
    fees = v.reports.filter(k % 11 == 0).withColumn("fee_id", k)
    return lg.build_lookthrough(v.cutoffs, h, fees, 30)


@view("fund_docs", """
SELECT o_orderkey AS document_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 40 DAY AS publication_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 41 DAY AS available_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 42 DAY AS retrieved_at, 'R' || o_custkey AS source_record,
 CASE o_orderkey % 3 WHEN 0 THEN 'H' || o_custkey ELSE 'H' || o_orderkey END AS source_hash, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey + 1 WHEN 1 THEN 999999999 END AS amends FROM orders""")
def _fund_docs(v):
    k, d, c = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp"), F.col("o_custkey").cast("string")
    day = lambda n: F.timestamp_add("DAY", F.lit(n), d)
    return v.table("orders").select(k.alias("document_id"), day(40).alias("publication_at"), day(41).alias("available_at"), day(42).alias("retrieved_at"), F.concat(F.lit("R"), c).alias("source_record"),
                                    F.when(k % 3 == 0, F.concat(F.lit("H"), c)).otherwise(F.concat(F.lit("H"), k.cast("string"))).alias("source_hash"), F.when(k % 5 == 0, k + 1).when(k % 5 == 1, F.lit(999999999)).alias("amends"))


@query("append_holdings", "document_id:l verdict:s why:s reporting_lag:l", f"""
SELECT document_id, CASE WHEN len(p) > 0 THEN 'invalid' ELSE 'recorded' END AS verdict, array_to_string(p, ';') AS why, 41 - k % 50 AS reporting_lag FROM (SELECT *, {_list([("k % 23 = 0", "identity"), ("k % 50 > 40", "published before as-of"), ("k % 31 = 0", "no reported total"),
 ("k % 3 <> 0 AND source_hash <> 'H' || substr(source_record, 2) AND amends IS NULL", "changed without amendment"), ("amends IS NOT NULL AND amends > (SELECT max(o_orderkey) FROM orders)", "unknown parent")])} AS p FROM (SELECT *, document_id AS k FROM fund_docs))""")
def _(v):
    k = F.col("o_orderkey")
    reports = v.table("orders").select(k.alias("document_id"), F.when(k % 23 != 0, F.lit("F")).alias("fund_id"), F.lit("S").alias("share_class_id"), F.date_add(F.to_date("o_orderdate"), (k % 50).cast("int")).alias("as_of"),
                                       F.when(k % 31 != 0, 100.0).alias("reported_total"), F.lit(3).alias("weighted"), F.lit("[]").alias("positions"))
    stored = v.fund_docs.groupBy("source_record").agg(F.max("retrieved_at").alias("retrieved_at")).withColumn("source_hash", F.concat(F.lit("H"), F.substring("source_record", 2, 20))).withColumn("report_id", F.lit("none"))
    r = lg.append_holdings(reports, v.fund_docs, stored)
    return r.withColumn("why", F.array_join("problems", ";"))


@query("explode_holdings", "report_id:l ordinal:l name:s weight:f", "SELECT o_orderkey AS report_id, i AS ordinal, list_extract(['cash','bond','stock'], i+1) AS name, o_totalprice*(i+1)/6e0 AS weight FROM orders, (SELECT unnest([0,1,2]) AS i) n")
def _(v):
    names = F.array(*[F.struct(F.lit(n).alias("name"), (F.col("o_totalprice") * (i + 1) / 6.0).alias("weight")) for i, n in enumerate(("cash", "bond", "stock"))])
    from tidemark.sources.documents import explode_positions
    return explode_positions(v.table("orders").select(F.col("o_orderkey").alias("report_id"), names.alias("positions")))
