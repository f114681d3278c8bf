"""Queries over joins."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import joins

KEY = "ticker:s session_date:d "


@query("asof_reference", KEY + "snapshot_date:d active:b raw_type:s exchange:s currency:s", """
SELECT b.ticker, b.session_date, r.snapshot_date, r.active, r.raw_type, r.exchange, r.currency
FROM bars b ASOF LEFT JOIN refs r ON b.ticker = r.ticker AND b.session_date >= r.snapshot_date""")
def _(v):
    return joins.asof_join(v.bars, v.refs, "ticker", "session_date", "snapshot_date",
                           ["snapshot_date", "active", "raw_type", "exchange", "currency"], tie=["active"])


@query("asof_join_bucketed", "l_orderkey:l l_linenumber:l l_partkey:l l_extendedprice:f2 ticker:s ship:d event_date:d accession:l", """
SELECT l.*, r.event_date, r.accession FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS ship FROM lineitem) l
 ASOF LEFT JOIN (SELECT ticker, event_date, max(accession) AS accession FROM iev GROUP BY 1, 2) r ON l.ticker = r.ticker AND l.ship >= r.event_date""")
def _(v):
    left = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                      F.col("l_suppkey").cast("string").alias("ticker"),
                                      F.to_date("l_shipdate").alias("ship"))
    return joins.asof_join(left, v.iev, "ticker", "ship", "event_date", ["event_date", "accession"],
                           tie=["accession"], bucket_days=32)


@view("reports", """
SELECT CAST(o_custkey % 50 AS VARCHAR) AS fund, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS as_of,
  CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 40 AS INTEGER) * INTERVAL 1 DAY AS available,
  CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 40 AS INTEGER) * INTERVAL 1 DAY + CAST(o_orderkey % 90 AS INTEGER) * INTERVAL 1 HOUR AS retrieved,
  o_totalprice AS total FROM orders""")
def _reports(v):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    available = F.timestamp_add("DAY", (k % 40).cast("int"), d)
    return v.table("orders").select((F.col("o_custkey") % 50).cast("string").alias("fund"), k.alias("report_id"),
                                    F.to_date("o_orderdate").alias("as_of"), available.alias("available"),
                                    F.timestamp_add("HOUR", (k % 90).cast("int"), available).alias("retrieved"),
                                    F.col("o_totalprice").alias("total"))


@view("cutoffs", """
SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS fund, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS cutoff FROM orders""")
def _cutoffs(v):
    return v.table("orders").select((F.col("o_custkey") % 50).cast("string").alias("fund"),
                                    F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("cutoff")).distinct()


@query("asof_bitemporal", "fund:s cutoff:t report_id:l as_of:d total:f2", """
SELECT c.fund, c.cutoff, r.report_id, r.as_of, r.total FROM cutoffs c LEFT JOIN (
  SELECT * FROM (SELECT c.fund, c.cutoff, r.report_id, r.as_of, r.total,
    row_number() OVER (PARTITION BY c.fund, c.cutoff ORDER BY r.as_of DESC, r.available DESC, r.retrieved DESC, r.report_id DESC) AS rn
    FROM cutoffs c JOIN reports r ON c.fund = r.fund AND r.available <= c.cutoff AND r.retrieved <= c.cutoff) WHERE rn = 1) r
ON c.fund = r.fund AND c.cutoff = r.cutoff""")
def _(v):
    return joins.asof_bitemporal(v.cutoffs, v.reports, "fund", "cutoff", "as_of", "available", "retrieved",
                                 ["report_id", "as_of", "total"])


@query("prior_trade_join", KEY + "close:f prior_close:f prior_date:d", """
SELECT * FROM (SELECT *, lag(close) OVER w AS prior_close, lag(session_date) OVER w AS prior_date FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY session_date)) WHERE prior_close IS NOT NULL""")
def _(v):
    return joins.prior_bar(v.bars)


@query("benchmark_join", KEY + "close:f bench_close:f", "SELECT * FROM bars JOIN bench USING (session_date)")
def _(v):
    return joins.with_benchmark(v.bars, v.bench)


@view("targets", """
SELECT b.*, c.target_1, c.target_5, t1.close AS close_t1, t5.close AS close_t5 FROM bars b
JOIN (SELECT session_date, lead(session_date,1) OVER (ORDER BY session_date) AS target_1, lead(session_date,5) OVER (ORDER BY session_date) AS target_5 FROM bench) c
  ON b.session_date = c.session_date
LEFT JOIN bars t1 ON t1.ticker = b.ticker AND t1.session_date = c.target_1 LEFT JOIN bars t5 ON t5.ticker = b.ticker AND t5.session_date = c.target_5""")
def _targets(v):
    return joins.forward_targets(v.bars, v.bench, [1, 5])


@query("calendar_target_join", KEY + "target_1:d close_t1:f target_5:d close_t5:f", "SELECT * FROM targets")
def _(v):
    return v.targets


@view("reactions", """
SELECT e.ticker, e.event_date, min(h.session_date) AS reaction_date FROM
 (SELECT DISTINCT ticker, event_date FROM iev WHERE event_type = 'results') e
 JOIN (SELECT ticker, min(session_date) AS first FROM hist GROUP BY 1) f ON e.ticker = f.ticker AND e.event_date > f.first
 JOIN hist h ON h.ticker = e.ticker AND h.session_date > e.event_date GROUP BY 1, 2""")
def _reactions(v):
    return joins.reaction_session(v.iev.filter("event_type = 'results'"), v.hist)


@query("next_session_join", "ticker:s event_date:d reaction_date:d", "SELECT * FROM reactions")
def _(v):
    return v.reactions


@view("asks", """
SELECT DISTINCT CAST(o_custkey % 100 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS ask_date FROM orders""")
def _asks(v):
    return v.table("orders").select((F.col("o_custkey") % 100).cast("string").alias("ticker"),
                                    F.to_date("o_orderdate").alias("ask_date")).distinct()


@query("on_or_after_7d", "ticker:s ask_date:d matched_ts:d close:f", """
SELECT a.ticker, a.ask_date, CASE WHEN b.session_date - a.ask_date <= 7 THEN b.session_date END AS matched_ts,
  CASE WHEN b.session_date - a.ask_date <= 7 THEN b.close END AS close
FROM asks a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.ask_date <= b.session_date""")
def _(v):
    return joins.nearest(v.asks, v.bars, "ticker", "ask_date", "session_date", ["close"], "after", 7)


@query("on_or_before_7d", "ticker:s ask_date:d matched_ts:d close:f", """
SELECT a.ticker, a.ask_date, CASE WHEN a.ask_date - b.session_date <= 7 THEN b.session_date END AS matched_ts,
  CASE WHEN a.ask_date - b.session_date <= 7 THEN b.close END AS close
FROM asks a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.ask_date >= b.session_date""")
def _(v):
    return joins.nearest(v.asks, v.bars, "ticker", "ask_date", "session_date", ["close"], "before", 7)


@query("nearby_event_join", KEY + "jump_ratio:f", """
SELECT * FROM (SELECT ticker, session_date, greatest(close/lag(close) OVER w, lag(close) OVER w/close) AS jump_ratio FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY session_date)) j
WHERE jump_ratio >= 1.8e0 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ticker = j.ticker AND abs(s.split_date - j.session_date) <= 3)""")
def _(v):
    return joins.unexplained_jumps(v.bars, v.splits, 1.8)


@view("id_refs", "SELECT ticker, 'CIK:' || CAST((CAST(ticker AS BIGINT) // 3) * 3 AS VARCHAR) AS security_id FROM kinds")
def _id_refs(v):
    return v.kinds.select("ticker", F.concat(F.lit("CIK:"), (F.floor(F.col("ticker").cast("bigint") / 3) * 3)
                                             .cast("string")).alias("security_id"))


@query("alias_identity_join", "identity:s ticker:s session_date:d close:f", """
SELECT DISTINCT o.ticker, o.session_date, o.close, i.security_id AS identity FROM obs o
JOIN (SELECT DISTINCT security_id FROM id_refs) i ON o.security_id = i.security_id
  OR o.ticker IN (SELECT ticker FROM id_refs r WHERE r.security_id = i.security_id)""")
def _(v):
    return joins.follow_identity(v.obs, v.id_refs, v.id_refs.select("security_id").distinct())


@query("members_identity_join", "snapshot_id:l identity_id:l name:s nation:s", """
SELECT o_orderkey AS snapshot_id, l_suppkey AS identity_id, s_name AS name, o_orderstatus AS nation
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def _(v):
    snapshots = v.table("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("nation"))
    members = v.table("lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("identity_id"))
    identities = v.table("supplier").select(F.col("s_suppkey").alias("identity_id"), F.col("s_name").alias("name"))
    return joins.ledger_members(snapshots, members, identities)


@query("documents_join", "report_id:l fund:s source:s n_chars:l", """
SELECT r.report_id, r.fund, d.source, d.n_chars FROM reports r JOIN documents d ON r.report_id = d.doc_id""")
def _(v):
    return v.reports.join(v.table("documents").select(F.col("doc_id").alias("report_id"), "source", "n_chars"), "report_id")


@view("terms", """
SELECT o_orderkey AS accession, o_orderkey AS security_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS supersedes,
  CASE WHEN o_orderkey % 4 = 1 THEN o_custkey END AS successor_id, o_totalprice AS cash FROM orders""")
def _terms(v):
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("accession"), k.alias("security_id"),
                                    F.when(k % 3 == 0, F.floor(k / 2)).alias("supersedes"),
                                    F.when(k % 4 == 1, F.col("o_custkey")).alias("successor_id"),
                                    F.col("o_totalprice").alias("cash"))


@query("successor_join", "accession:l security_id:l next_id:l next_next_id:l", """
SELECT t.accession, t.security_id, t.successor_id AS next_id, n.successor_id AS next_next_id FROM terms t
LEFT JOIN terms n ON n.security_id = t.successor_id
WHERE t.accession NOT IN (SELECT supersedes FROM terms WHERE supersedes IS NOT NULL)""")
def _(v):
    live = joins.apply_supersedes(v.terms)
    return joins.successor_path(live.select("accession", "security_id"), v.terms)


@view("holdings", """
SELECT CAST(c_nationkey AS VARCHAR) AS manager, year(o_orderdate)*4 + quarter(o_orderdate) AS period, CAST(l_partkey AS VARCHAR) AS cusip,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS shares, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100e0 AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def _holdings(v):
    d = F.col("o_orderdate")
    j = (v.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
         .join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(v.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")))
    return j.groupBy(F.col("c_nationkey").cast("string").alias("manager"),
                     (F.year(d) * 4 + F.quarter(d)).alias("period"), F.col("l_partkey").cast("string").alias("cusip")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("shares"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 100.0).alias("value"))


@query("quarter_over_quarter", "manager:s cusip:s period:l shares:f2 prior_shares:f2 action:s", """
SELECT h.manager, h.cusip, h.period, h.shares, p.shares AS prior_shares, CASE WHEN p.shares IS NULL OR p.shares <= 0 THEN 'New'
  WHEN (h.shares-p.shares)/p.shares*100 >= 10 THEN 'Increased' WHEN (h.shares-p.shares)/p.shares*100 <= -10 THEN 'Reduced' ELSE 'Held' END AS action
FROM holdings h LEFT JOIN holdings p ON h.manager = p.manager AND h.cusip = p.cusip AND h.period = p.period + 1""")
def _(v):
    return joins.holdings_change(v.holdings)


@view("fx", """
SELECT c AS currency, session_date AS rate_date, bench_close/1000e0 AS rate FROM bench, (SELECT unnest(['EUR','GBP']) AS c)
WHERE day(session_date) % 12 <> 5""")
def _fx(v):
    return (v.bench.filter(F.day("session_date") % 12 != 5)
            .select(F.explode(F.array(F.lit("EUR"), F.lit("GBP"))).alias("currency"),
                    F.col("session_date").alias("rate_date"), (F.col("bench_close") / 1000.0).alias("rate")))


@query("fx_convert", "o_orderkey:l currency:s amount:f4", """
SELECT o_orderkey, currency, CASE WHEN currency='USD' THEN amount WHEN d - f.rate_date <= 7 THEN amount*f.rate END AS amount
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency FROM orders) o
ASOF LEFT JOIN (SELECT currency AS fc, rate_date, rate FROM fx) f ON o.currency = f.fc AND o.d >= f.rate_date""")
def _(v):
    k = F.col("o_orderkey") % 3
    money = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("amount"),
                                     F.when(k == 0, "USD").when(k == 1, "EUR").otherwise("GBP").alias("currency"))
    return joins.fx_convert(money, v.fx, ["amount"], "d")


@query("issuer_evidence_asof", "fund:s cutoff:t report_id:l total:f2", """
SELECT c.fund, c.cutoff, r.report_id, r.total FROM cutoffs c ASOF LEFT JOIN
 (SELECT fund, available, max(report_id) AS report_id, arg_max(total, report_id) AS total FROM reports GROUP BY 1, 2) r
ON c.fund = r.fund AND c.cutoff >= r.available""")
def _(v):
    ev = v.reports.select("fund", "report_id", "total", F.col("available").alias("public_at"))
    return joins.evidence_as_of(ev, v.cutoffs, "fund")


@query("full_outer_diff", "part:l current_value:f2 incoming_value:f2 status:s", """
SELECT coalesce(a.part, b.part) AS part, a.v AS current_value, b.v AS incoming_value,
  CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN abs(a.v-b.v) > 1e-6 THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT l_partkey AS part, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag='R' GROUP BY 1) a FULL OUTER JOIN
     (SELECT l_partkey AS part, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag='A' GROUP BY 1) b ON a.part = b.part""")
def _(v):
    def best(flag):
        return (v.table("lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part"))
                .agg(F.max("l_quantity").alias("v")))
    return joins.reconcile(best("R"), best("A"), "part", "v")


@query("existing_key_anti", "ticker:s ask_date:d", """
SELECT a.ticker, a.ask_date FROM asks a WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = a.ticker AND b.session_date = a.ask_date)""")
def _(v):
    return joins.except_keys(v.asks, v.bars.withColumnRenamed("session_date", "ask_date"), ["ticker", "ask_date"])
