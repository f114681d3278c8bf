"""Queries over scores, datasets, folds, journals and drift."""

from pyspark.sql import functions as F

from tidemark import policy
from tidemark.catalog.frames import _NAMES, outcome_sql
from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.operators import scores
from tidemark.plans import journals, research

SCORE_SQL = """
SELECT {by} count(*) AS n, avg((p-label)*(p-label)) AS brier,
  avg(-(label*ln(q)+(1-label)*ln(1e0-q))) AS log_loss, avg(CASE WHEN (p>=0.5e0) = (label=1) THEN 1e0 ELSE 0e0 END) AS hit_rate, avg(label) AS base_rate,
  1e0 - avg((p-label)*(p-label))/nullif(avg(label)*(1e0-avg(label)), 0) AS brier_skill
FROM (SELECT *, least(greatest(p, 1e-6), 1e0-1e-6) AS q FROM preds) {group}"""


@query("brier", "ticker:s n:l brier:f", SCORE_SQL.format(by="ticker,", group="GROUP BY ticker"))
def _(v):
    return scores.score(v.preds, ["ticker"])


@query("log_loss", "ticker:s n:l log_loss:f", SCORE_SQL.format(by="ticker,", group="GROUP BY ticker"))
def _(v):
    return scores.score(v.preds, ["ticker"])


@query("brier_skill", "n:l brier:f log_loss:f hit_rate:f base_rate:f brier_skill:f", SCORE_SQL.format(by="", group=""))
def _(v):
    return scores.score(v.preds)


BINS = """
SELECT b.bin, (b.bin-1)/10e0 AS low, b.bin/10e0 AS high, count(p) AS n, avg(p) AS forecast, avg(label) AS observed
FROM (SELECT unnest(generate_series(1, 10)) AS bin) b LEFT JOIN preds ON CAST(floor(least(p, 0.99e0)*10+1e-9) AS BIGINT)+1 = b.bin GROUP BY 1"""


@view("bins", BINS)
def _bins(v):
    return scores.reliability(v.preds)


@query("reliability_bins", "bin:l low:f high:f n:l forecast:f observed:f", "SELECT * FROM bins")
def _(v):
    return v.bins


@query("ece", "ece:f", "SELECT sum(n*abs(round(forecast,4)-round(observed,4)))/sum(n) AS ece FROM bins WHERE n > 0")
def _(v):
    return scores.ece(v.bins)


@query("calibration_fit", "slope:f intercept:f samples:l")
def _(v):
    return scores.calibration_slope(v.preds)


BOOT = """
SELECT count(*) AS clusters, max(lo) AS lower95, max(hi) AS upper95, max(m) AS samples FROM c, (
  SELECT list_sort(list(e)) AS a, len(a) AS m, a[1+CAST(floor(0.025e0*(len(a)-1)) AS BIGINT)] AS lo, a[1+CAST(floor(0.975e0*(len(a)-1)) AS BIGINT)] AS hi
  FROM (SELECT r, sum(num)/nullif(sum(den),0) AS e FROM (SELECT r, CAST('0x' || substr(md5('20260804-' || r || '-' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM c) AS pick
      FROM c, (SELECT unnest(generate_series(0, 399)) AS r)) d JOIN c ON c.slot = d.pick GROUP BY r))"""


@query("cluster_bootstrap", "clusters:l lower95:f upper95:f samples:l",
       "WITH c AS (SELECT session_date, sum(label) AS num, count(*) AS den, row_number() OVER (ORDER BY session_date)-1 AS slot FROM preds GROUP BY 1) " + BOOT)
def _(v):
    return scores.cluster_bootstrap(v.preds, "session_date", F.col("label"), F.lit(1))


@query("scorecard", "n:l brier:f log_loss:f hit_rate:f base_rate:f brier_skill:f ece:f lower95:f upper95:f clusters:l slope:f4 intercept:f4")
def _(v):
    return scores.scorecard(v.preds)


# --- dataset, folds, split -------------------------------------------------------------------------------------------

LIMITS = {"min_volume": 30000.0}
DATASET = f"""
SELECT *, 5 AS horizon, abs(excess_return) >= 0.15e0 AS bm, excess_return > 0.005e0 AS u, abs(excess_return) <= 0.005e0 AS ne FROM (
  SELECT *, CASE WHEN ok THEN sr-br END AS excess_return, CASE WHEN ok THEN dd END AS max_drawdown, en AS entry_date, ex AS exit_date
  FROM ({outcome_sql(5).split('FROM (', 1)[1].rsplit(')', 1)[0]}))
WHERE complete AND excess_return IS NOT NULL AND close >= 2 AND dollar_volume >= 30000 AND idx >= 126 AND clean"""


@view("dataset", f"SELECT *, CAST(bm AS INTEGER) AS big_move, CAST(u AS INTEGER) AS up, CAST(ne AS INTEGER) AS neutral FROM ({DATASET})")
def _dataset(v):
    return research.build_dataset(v.hist, 5, **LIMITS)


@query("build_dataset", "ticker:s session_date:d entry_date:d exit_date:d excess_return:f max_drawdown:f big_move:l up:l neutral:l "
       + " ".join(f"{c}:f" for c in _NAMES), "SELECT * FROM dataset")
def _(v):
    return v.dataset


@query("dataset_summary", "rows:l securities:l sessions:l first_session:d last_session:d big_move_rate:f up_rate:f neutral_rate:f mean_excess:f", """
SELECT count(*) AS rows, count(DISTINCT ticker) AS securities, count(DISTINCT session_date) AS sessions, min(session_date) AS first_session,
  max(session_date) AS last_session, avg(big_move) AS big_move_rate, avg(up) AS up_rate, avg(neutral) AS neutral_rate, avg(excess_return) AS mean_excess FROM dataset""")
def _(v):
    return research.dataset_summary(v.dataset)


FOLDS = """
SELECT p+1 AS fold, (SELECT min(session_date) FROM bars) AS train_start, d[e] AS train_end, d[e+gap+1] AS test_start, d[e+gap+block] AS test_end
FROM (SELECT *, block*(p+1)+gap*p AS e FROM (SELECT d, p, 5 AS gap, CAST(floor((len(d)-25)/6e0) AS BIGINT) AS block
  FROM (SELECT list_sort(list(DISTINCT session_date)) AS d FROM bars), (SELECT unnest(generate_series(0,4)) AS p))) WHERE block >= 1 AND e+gap+block <= len(d)"""


@view("folds", FOLDS)
def _folds(v):
    return research.walk_forward_folds(v.bars, 5, 5)


@query("walk_forward_folds", "fold:l train_start:d train_end:d test_start:d test_end:d", "SELECT * FROM folds")
def _(v):
    return v.folds


@view("exits", "SELECT *, CASE WHEN n - idx > 6 THEN x END AS exit_date, CASE WHEN close > bench_close THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(session_date, 6) OVER (PARTITION BY ticker ORDER BY session_date) AS x FROM hist)")
def _exits(v):
    from pyspark.sql import Window
    w = Window.partitionBy("ticker").orderBy("session_date")
    return (v.hist.withColumn("exit_date", F.lead("session_date", 6).over(w))
            .withColumn("label", (F.col("close") > F.col("bench_close")).cast("int")))


@view("split", """
SELECT e.ticker, e.session_date, e.exit_date, e.label, f.fold, CASE WHEN session_date BETWEEN test_start AND test_end THEN 'test'
  WHEN session_date <= train_end AND coalesce(exit_date >= test_start, false) THEN 'purged' WHEN session_date <= train_end THEN 'train' END AS role FROM exits e, folds f""")
def _split(v):
    return research.apply_split(v.exits, v.folds)


@query("apply_split", "fold:l role:s n:l first_session:d last_session:d", """
SELECT fold, role, count(*) AS n, min(session_date) AS first_session, max(session_date) AS last_session FROM split WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return v.split.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first_session"),
                                               F.max("session_date").alias("last_session"))


@query("leakage_check", "fold:l ticker:s session_date:d", """
SELECT s.fold, s.ticker, s.session_date FROM split s JOIN (SELECT fold, min(session_date) AS first FROM split WHERE role = 'test' GROUP BY 1) t ON s.fold = t.fold
WHERE s.role IN ('train', 'purged') AND (s.session_date >= first OR coalesce(s.exit_date >= first, false))""")
def _(v):
    # Purged rows are put back as training rows, so that the check has something to find.
    return research.leakage(v.split.withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role"))))


@query("base_rate_champion", "fold:l rate:f train_rows:l",
       "SELECT fold, avg(label) AS rate, count(*) AS train_rows FROM split WHERE role = 'train' GROUP BY 1")
def _(v):
    return research.champion(v.split, "label")


def _experiment_rows(v):
    """Every history row with complete features and an outcome; the label is a move above the median size."""
    from tidemark.operators import frames
    rows = frames.outcome_sessions(frames.features(v.hist), 5).filter("complete AND excess_return IS NOT NULL")
    return rows.withColumn("big_move", (F.abs("excess_return") >= 0.25).cast("int"))


@query("logistic_challenger", "fold:l train_rows:l test_rows:l champion_brier:f challenger_brier:f brier_skill:f")
def _(v):
    return research.fold_scores(research.experiment_split(_experiment_rows(v)), "big_move", list(policy.FEATURES))


@query("run_experiment", "folds:l wins:l champion_brier:f challenger_brier:f avg_skill:f max_ece:f gates:s verdict:s")
def _(v):
    return research.run_experiment(_experiment_rows(v)).withColumn("gates", F.array_join("gate_failures", ";"))


@query("fold_average", "folds:l wins:l champion_brier:f challenger_brier:f avg_skill:f")
def _(v):
    split = research.experiment_split(_experiment_rows(v), horizon=21)
    return research.experiment_verdict(research.fold_scores(split, "big_move", list(policy.FEATURES)))


@query("ablation", "feature:s full_brier:f without_brier:f harm:f")
def _(v):
    return research.ablation(_experiment_rows(v))


@query("shadow_predictions", "session_date:d ticker:s p:f base:f status:s prediction_hash:s")
def _(v):
    from tidemark.operators import frames
    open_rows = frames.features(v.hist).filter("complete")
    return research.shadow_session(_experiment_rows(v), open_rows)


# --- drift -----------------------------------------------------------------------------------------------------------

_DRIFT = " UNION ALL ".join(f"""SELECT '{c}' AS feature, avg({c}) FILTER (WHERE NOT nw) AS baseline_mean, avg({c}) FILTER (WHERE nw) AS recent_mean,
 stddev_samp({c}) FILTER (WHERE NOT nw) AS sd FROM tagged""" for c in _NAMES)
_SEV = "CASE WHEN shift IS NULL THEN 'unknown' WHEN abs(shift) >= 1 THEN 'serious' WHEN abs(shift) >= 0.5 THEN 'watch' ELSE 'stable' END"


@query("feature_drift", "feature:s baseline_mean:f recent_mean:f shift:f severity:s", f"""
WITH tagged AS (SELECT *, session_date >= (SELECT min(d) FROM (SELECT DISTINCT session_date AS d FROM feats ORDER BY d DESC LIMIT 21)) AS nw FROM feats),
raw AS ({_DRIFT})
SELECT feature, baseline_mean, recent_mean, shift, CASE WHEN const THEN 'constant' ELSE {_SEV} END AS severity
FROM (SELECT *, sd <= greatest(abs(baseline_mean), 1e0)*1e-9 AS const, CASE WHEN sd > greatest(abs(baseline_mean), 1e0)*1e-9 THEN (recent_mean-baseline_mean)/sd END AS shift FROM raw)""")
def _(v):
    return scores.feature_drift(v.feats, _NAMES)


@query("prediction_drift", "feature:s baseline_mean:f recent_mean:f shift:f severity:s", f"""
SELECT *, {_SEV} AS severity FROM (SELECT 'p' AS feature, avg(p) FILTER (WHERE NOT nw) AS baseline_mean, avg(p) FILTER (WHERE nw) AS recent_mean,
  (avg(p) FILTER (WHERE nw) - avg(p) FILTER (WHERE NOT nw))/stddev_samp(p) FILTER (WHERE NOT nw) AS shift
FROM (SELECT *, session_date >= (SELECT min(d) FROM (SELECT DISTINCT session_date AS d FROM preds ORDER BY d DESC LIMIT 21)) AS nw FROM preds))""")
def _(v):
    return scores.feature_drift(v.preds, ["p"])


@query("model_risk_events", "source:s subject:s baseline_mean:f recent_mean:f shift:f severity:s")
def _(v):
    return research.model_risk_events(v.obs, v.dataset, v.preds)


# --- journals --------------------------------------------------------------------------------------------------------

@view("journal", """
SELECT CAST(o_custkey % 100 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS decision_date, o_orderkey AS entry_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Hold' WHEN 1 THEN 'Sell' WHEN 2 THEN 'Buy' ELSE 'Ultra Buy' END AS action,
  CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS confidence, 'M' || o_custkey % 20 AS manager,
  CASE o_orderkey % 3 WHEN 0 THEN 'New' WHEN 1 THEN 'Increased' ELSE 'Held' END AS change, (o_orderkey % 100)/100e0 AS p, 5 + o_orderkey % 17 AS horizon_sessions,
  'model-' || o_custkey % 7 AS model_id, CASE WHEN o_orderkey % 2 = 0 THEN 'up' WHEN o_orderkey % 5 = 0 THEN 'down' END AS direction FROM orders""")
def _journal(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, h = k % 4, k % 3
    return v.table("orders").select(
        (c % 100).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("decision_date"), k.alias("entry_id"),
        F.when(a == 0, "Hold").when(a == 1, "Sell").when(a == 2, "Buy").otherwise("Ultra Buy").alias("action"),
        F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "Medium").otherwise("Low").alias("confidence"),
        F.concat(F.lit("M"), (c % 20).cast("string")).alias("manager"),
        F.when(h == 0, "New").when(h == 1, "Increased").otherwise("Held").alias("change"), ((k % 100) / 100.0).alias("p"),
        (5 + k % 17).alias("horizon_sessions"), F.concat(F.lit("model-"), (c % 7).cast("string")).alias("model_id"),
        F.when(k % 2 == 0, "up").when(k % 5 == 0, "down").alias("direction"))


def graded_sql(asks: str) -> str:
    """Outcome of every (symbol, decision_date, horizon_days) of ``asks`` by a plain range join."""
    return f"""
SELECT g.*, CASE WHEN status = 'matured' THEN sr END AS stock_return, CASE WHEN status = 'matured' THEN br END AS benchmark_return,
  CASE WHEN status = 'matured' THEN sr-br END AS excess_return, CASE WHEN status = 'matured' THEN (low/ec-1)*100 END AS max_drawdown,
  CASE WHEN status = 'matured' THEN (rel-1)*100 END AS max_relative_drawdown,
  CASE WHEN status = 'matured' THEN CASE WHEN sr-br > 0.5 THEN 'outperformed' WHEN sr-br < -0.5 THEN 'underperformed' ELSE 'neutral' END END AS verdict
FROM (SELECT *, CASE WHEN last IS NULL THEN 'unavailable' WHEN ed IS NULL THEN 'pending' WHEN xd IS NULL AND last < target THEN 'pending' WHEN xd IS NULL THEN 'unavailable'
    WHEN NOT ok THEN 'unavailable' ELSE 'matured' END AS status, (xc/ec-1)*100 AS sr, (xb/eb-1)*100 AS br FROM (
  SELECT a.symbol, a.decision_date, a.horizon_days, a.target, l.last, e.ed, e.ec, e.eb, x.xd, x.xc, x.xb,
    (SELECT bool_and(h.clean) FROM hist h WHERE h.ticker = a.symbol AND h.session_date BETWEEN e.ed AND x.xd) AS ok,
    (SELECT count(*)-1 FROM hist h WHERE h.ticker = a.symbol AND h.session_date BETWEEN e.ed AND x.xd) AS held,
    (SELECT min(h.close) FROM hist h WHERE h.ticker = a.symbol AND h.session_date BETWEEN e.ed AND x.xd) AS low,
    (SELECT min((h.close/e.ec)/(h.bench_close/e.eb)) FROM hist h WHERE h.ticker = a.symbol AND h.session_date BETWEEN e.ed AND x.xd) AS rel
  FROM (SELECT DISTINCT symbol, decision_date, horizon_days, decision_date + CAST(horizon_days AS INTEGER) AS target FROM {asks}) a
  LEFT JOIN (SELECT ticker, max(session_date) AS last FROM hist GROUP BY 1) l ON l.ticker = a.symbol
  ASOF LEFT JOIN (SELECT ticker, session_date AS ed, close AS ec, bench_close AS eb FROM hist) e ON e.ticker = a.symbol AND a.decision_date < e.ed
  LEFT JOIN (SELECT symbol, decision_date, horizon_days, min(h.session_date) AS xd, arg_min(h.close, h.session_date) AS xc, arg_min(h.bench_close, h.session_date) AS xb
    FROM (SELECT DISTINCT symbol, decision_date, horizon_days FROM {asks}) q JOIN hist h ON h.ticker = q.symbol AND h.session_date BETWEEN decision_date + CAST(horizon_days AS INTEGER) AND decision_date + CAST(horizon_days AS INTEGER) + 15
    GROUP BY 1, 2, 3) x ON x.symbol = a.symbol AND x.decision_date = a.decision_date AND x.horizon_days = a.horizon_days)) g"""


def _long(v, horizons):
    return v.journal.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))


@view("journal_long", "SELECT *, unnest([30, 90, 180, 365]) AS horizon_days FROM journal")
def _jl(v):
    return _long(v, [30, 90, 180, 365])


@view("outcomes", graded_sql("journal_long"))
def _outcomes(v):
    return journals.outcome_calendar_days(v.journal_long, v.hist)


@query("outcome_calendar_days", "symbol:s decision_date:d horizon_days:l status:s entry_date:d exit_date:d sessions_held:l stock_return:f benchmark_return:f "
       "excess_return:f max_drawdown:f max_relative_drawdown:f verdict:s", """
SELECT *, CASE WHEN status = 'matured' THEN ed END AS entry_date, CASE WHEN status = 'matured' THEN xd END AS exit_date, CASE WHEN status = 'matured' THEN held END AS sessions_held FROM outcomes""")
def _(v):
    return v.outcomes


@view("journal_days", "SELECT *, greatest(1, CAST(round_even(horizon_sessions*7/5e0, 0) AS INTEGER)) AS horizon_days FROM journal")
def _jd(v):
    return v.journal.withColumn("horizon_days", F.greatest(F.lit(1), F.rint(F.col("horizon_sessions") * 7 / 5).cast("int")))


@view("day_outcomes", graded_sql("journal_days"))
def _do(v):
    return journals.outcome_calendar_days(v.journal_days, v.hist)


@view("graded", """
SELECT j.*, o.status, o.excess_return, CASE WHEN o.status = 'matured' THEN abs(round(o.excess_return, 2)/100) >= 0.15e0 END AS realised_swing,
  CASE WHEN o.status = 'matured' THEN CASE WHEN round(o.excess_return, 2) > 0 THEN 'up' ELSE 'down' END END AS realised_direction
FROM journal_days j JOIN day_outcomes o USING (symbol, decision_date, horizon_days)""")
def _graded(v):
    return journals.grade(v.journal, v.hist)


@query("grade_journal", "entry_id:l symbol:s horizon_days:l status:s excess_return:f realised_swing:b realised_direction:s", "SELECT * FROM graded")
def _(v):
    return v.graded


@query("signal_calibration", "horizon_days:l matured:l pending:l ungradeable:l hit_rate:f high_confidence_hit_rate:f neutral:l avg_excess:f avg_buy_drawdown:f", """
SELECT horizon_days, count(*) FILTER (WHERE status='matured') AS matured, count(*) FILTER (WHERE status='pending') AS pending, count(*) FILTER (WHERE status='unavailable') AS ungradeable,
  avg(okay)*100 AS hit_rate, avg(okay) FILTER (WHERE confidence='High')*100 AS high_confidence_hit_rate, count(*) FILTER (WHERE verdict='neutral') AS neutral,
  avg(round(excess_return,2)) AS avg_excess, avg(round(max_drawdown,2)) FILTER (WHERE action IN ('Buy','Ultra Buy')) AS avg_buy_drawdown
FROM (SELECT *, CASE WHEN verdict <> 'neutral' THEN CASE WHEN (action = 'Sell' AND round(excess_return, 2) < 0) OR (action <> 'Sell' AND round(excess_return, 2) > 0) THEN 1e0 ELSE 0e0 END END AS okay
  FROM journal_long JOIN outcomes USING (symbol, decision_date, horizon_days) WHERE action <> 'Hold' AND horizon_days < 365) GROUP BY 1""")
def _(v):
    return journals.signal_calibration(v.journal, v.hist, [30, 90, 180], ["Buy", "Ultra Buy"], ["Buy", "Ultra Buy", "Sell"])


@query("manager_skill", "manager:s ideas:l matured_90:l matured_180:l matured_365:l avg_excess:f hit_rate:f validated:b", """
SELECT manager, count(*) FILTER (WHERE horizon_days=365) AS ideas, count(*) FILTER (WHERE status='matured' AND horizon_days=90) AS matured_90,
  count(*) FILTER (WHERE status='matured' AND horizon_days=180) AS matured_180, count(*) FILTER (WHERE status='matured' AND horizon_days=365) AS matured_365,
  avg(round(excess_return,2)) FILTER (WHERE horizon_days=365) AS avg_excess,
  avg(CASE WHEN round(excess_return,2) > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE horizon_days=365 AND verdict <> 'neutral')*100 AS hit_rate,
  count(*) FILTER (WHERE status='matured' AND horizon_days=365) >= 10 AS validated
FROM journal_long JOIN outcomes USING (symbol, decision_date, horizon_days) WHERE change IN ('New','Increased') AND horizon_days > 30 GROUP BY 1""")
def _(v):
    return journals.manager_calibration(v.journal.drop("action").withColumnRenamed("change", "action"), v.hist)


@query("promotion_metrics", "sessions:l matured:l awaiting:l watches:l swings:l base_rate:f brier_skill:f alert_precision:f directional_accuracy:f calibration_error:f precision_lower95:f gates:s", """
WITH k AS (SELECT decision_date, count(*) FILTER (WHERE p >= 0.4e0 AND realised_swing) AS num, count(*) FILTER (WHERE p >= 0.4e0) AS den,
  row_number() OVER (ORDER BY decision_date)-1 AS slot, count(*) OVER () AS n FROM graded WHERE status='matured' GROUP BY 1),
e AS (SELECT r, sum(num)/nullif(sum(den), 0) AS e FROM (SELECT r, CAST('0x' || substr(md5('20260804-' || r || '-' || slot), 1, 8) AS BIGINT) % n AS slot
  FROM k, (SELECT unnest(generate_series(0, 399)) AS r) WHERE n >= 3) d JOIN k USING (slot) GROUP BY r),
b AS (SELECT a[1+CAST(floor(0.025e0*(len(a)-1)) AS BIGINT)] AS lo FROM (SELECT list_sort(list(e)) AS a FROM e WHERE e IS NOT NULL) WHERE len(a) >= 20),
m AS (
SELECT (SELECT count(DISTINCT decision_date) FROM graded) AS sessions, count(*) AS matured, (SELECT count(*) FROM graded WHERE status='pending') AS awaiting,
  count(*) FILTER (WHERE w) AS watches, count(*) FILTER (WHERE realised_swing) AS swings, avg(CAST(realised_swing AS INTEGER)) AS base_rate,
  1e0 - avg((p-CAST(realised_swing AS INTEGER))*(p-CAST(realised_swing AS INTEGER)))/(avg(CAST(realised_swing AS INTEGER))*(1e0-avg(CAST(realised_swing AS INTEGER)))) AS brier_skill,
  avg(CAST(realised_swing AS INTEGER)) FILTER (WHERE w) AS alert_precision, avg(CASE WHEN direction = realised_direction THEN 1e0 ELSE 0e0 END) FILTER (WHERE direction IS NOT NULL) AS directional_accuracy,
  (SELECT sum(n*abs(round(f,4)-round(o,4)))/sum(n) FROM (SELECT count(*) AS n, avg(p) AS f, avg(CAST(realised_swing AS INTEGER)) AS o FROM graded WHERE status='matured' GROUP BY CAST(floor(p*10+1e-9) AS BIGINT))) AS calibration_error,
  (SELECT lo FROM b) AS precision_lower95
FROM (SELECT *, p >= 0.2e0 AND p >= 2*0.2e0 AS w FROM graded WHERE status='matured'))
SELECT *, concat_ws(';', CASE WHEN sessions < 60 THEN 'sessions' END, CASE WHEN matured < 200 THEN 'matured' END, CASE WHEN watches < 40 THEN 'watches' END, CASE WHEN swings < 15 THEN 'swings' END,
  CASE WHEN coalesce(brier_skill < 0.1e0, true) THEN 'brier skill' END, CASE WHEN coalesce(calibration_error > 0.05e0, true) THEN 'calibration' END, CASE WHEN coalesce(alert_precision < 2*base_rate, true) THEN 'precision' END,
  CASE WHEN coalesce(precision_lower95 <= base_rate, true) THEN 'precision interval' END, CASE WHEN coalesce(directional_accuracy < 0.6e0, true) THEN 'direction' END, 'incident review', 'risk review') AS gates FROM m""")
def _(v):
    g = v.graded.withColumn("base", F.lit(0.2))
    out = journals.promotion_metrics(g.withColumn("alert_status", journals.alert_status("p", "base", F.lit(False), F.lit(True))))
    return out.withColumn("gates", F.array_join("gate_failures", ";"))


@query("journal_summary", "models:l predictions:l sessions:l first_session:d last_session:d", """
SELECT count(DISTINCT model_id) AS models, count(*) AS predictions, count(DISTINCT decision_date) AS sessions, min(decision_date) AS first_session, max(decision_date) AS last_session FROM journal""")
def _(v):
    return journals.journal_summary(v.journal)


@query("registry_summary", "model_id:s versions:l sequence:l action:s", """
SELECT model_id, count(*) AS versions, max(entry_id) AS sequence, arg_max(action, entry_id) AS action FROM journal GROUP BY 1""")
def _(v):
    return journals.current_models(v.journal.select("model_id", F.col("entry_id").alias("sequence"), "action"))
