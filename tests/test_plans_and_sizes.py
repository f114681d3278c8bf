"""What plans cost: sizes the planner can judge, shared steps that are computed once, lists that stay short."""

import duckdb
import pytest
from pyspark.sql import Window, functions as F

from tests.oracle import compare, connect
from tidemark import session
from tidemark.catalog.all import JOBS, oracle_texts
from tidemark.catalog.views import Views
from tidemark.functions import text
from tidemark.operators import frames, portfolio, scores
from tidemark.plans import hashtree, journals, research

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_the_planner_knows_how_many_daily_bars_there_are(spark):
    bars = Views(spark, SMALL).dense_bars
    assert int(str(_plan(bars).stats().sizeInBytes())) > 8 * bars.count()


def test_movers_number_the_calendar_once(spark):
    plan = _plan(JOBS["daily_movers"](spark, SMALL)).toString()
    assert "l_shipdate" not in plan


def test_outcomes_read_their_inputs_before_the_last_step(spark):
    plan = _plan(JOBS["capture_outcomes"](spark, SMALL)).toString()
    assert "Relation [" not in plan
    observations = Views(spark, SMALL).oc_obs
    assert int(str(_plan(observations).stats().sizeInBytes())) > 8 * observations.count()


def test_renamed_outcomes_equal_their_sql(spark):
    con = connect(SMALL)
    assert compare(JOBS["capture_renamed_outcomes"](spark, SMALL), con, oracle_texts()["capture_renamed_outcomes"]) is None


def test_lists_of_proofs_stay_short_when_rows_are_many(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hashtree, "proofs", lambda *a, whole=hashtree.proofs: seen.append(whole(*a)) or seen[-1])
    assert JOBS["audit_proofs"](spark, LARGE).where("NOT proven").count() == 0
    assert seen[0].agg(F.max(F.size("entries")).alias("n")).first().n <= 2 * hashtree.BLOCK


def test_visible_text_equals_its_sql_on_odd_references(spark, tmp_path):
    pages = ["a&amp <p title='x>y'>b", "&#128; &#0; &#9999999; &#xD800; &copy 2024", "&notit; &notin; &amp;lt; &AMP &amp", "&#x1F600; &#128512 &#00000000065; &#x000041;", "&unknown; & &; &#; &#x; &&&amp;amp;",
             "&#xFFFFFFFFFFFFFFFFFFFF;&#1;&#127;&#xFFFF;x", "", None, "<script>var a='<b>';</script >t<style>p{}</style><!-- c -->&nbsp;&eacute;&eacute", "<a \"q>t", "no reference  "]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    frame.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(JOBS["html_to_text"](spark, str(tmp_path)), con, oracle_texts()["html_to_text"]) is None


def test_no_frame_of_the_observations_runs_to_the_end_of_a_history(spark):
    plan = _plan(JOBS["build_observations"](spark, SMALL)).toString()
    assert "unboundedfollowing" not in plan.lower() and plan.count("Join LeftOuter") <= 3


def test_persistence_reads_its_inputs_before_the_last_step(spark):
    assert "Relation [" not in _plan(JOBS["persistence_check"](spark, SMALL)).toString()


def test_guidance_reads_its_documents_once(spark):
    plan = _plan(JOBS["guidance_extraction"](spark, SMALL)).toString()
    assert plan.count("Relation [") == 1


def test_conflicts_are_found_among_accepted_statements_of_one_document(spark):
    say = "We expect fiscal year 2024 revenue of {} million USD to {} million USD."
    rows = [(1, say.format(5, 9) + " " + say.format(5, 9)), (2, say.format(5, 9) + " " + say.format(6, 9)), (3, say.format(5, 9) + " " + say.format(9, 5)), (4, "Revenue was good. " + say.format(5, 9).upper())]
    got = text.extract_guidance(spark.createDataFrame(rows, "k int, text string"))
    assert sorted((r.k, r.verdict) for r in got.collect()) == [(1, "verified"), (1, "verified"), (2, "conflict"), (2, "conflict"), (3, "rejected"), (3, "verified"), (4, "verified")]


def test_shuffles_are_as_wide_as_the_input_asks_for(spark, monkeypatch):
    width = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 1 << 20)
    JOBS["upsert_latest"](spark, LARGE)
    assert int(spark.conf.get(width)) > 30
    JOBS["upsert_latest"](spark, SMALL)
    assert spark.conf.get(width, None) is None


def test_records_are_dealt_out_once_and_their_markup_is_read_once(spark):
    plan = _plan(JOBS["terminal_records"](spark, SMALL)).toString()
    assert plan.count("<script") == 1 and plan.count("Repartition") == 1


def test_walk_forward_reads_its_inputs_before_the_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(portfolio, "best_portfolio", lambda scored, *a, whole=portfolio.best_portfolio: seen.append(_plan(scored).toString()) or whole(scored, *a))
    assert JOBS["portfolio_walk_forward"](spark, SMALL).count() == len(seen) > 0
    assert not [p for p in seen if "Relation [" in p]


def test_variances_of_slices_are_those_of_single_portfolios(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "SLICE", 2)
    weights = spark.createDataFrame([(f"P{p}", s, float(10 * p + i)) for p in range(7) for i, s in enumerate("abc") if (p + i) % 4], "portfolio string, symbol string, weight double")
    cov = spark.createDataFrame([("a", "a", 0.04), ("b", "b", 0.09), ("a", "b", 0.01), ("b", "a", 0.01), ("b", "c", None), ("c", "c", 0.16)], "left string, right string, cov double")
    mu = spark.createDataFrame([(s, 0.1 * i) for i, s in enumerate("abc")], "symbol string, mu double")
    plain = {r.portfolio: r.variance for r in portfolio.portfolio_variance(weights, cov, list("abc")).collect()}
    got = {r.portfolio: r.variance for r in portfolio.score_portfolios(weights, mu, cov).collect()}
    assert got.keys() == plain.keys() and all(abs(got[p] - plain[p]) < 1e-12 for p in plain)


def test_promotion_reads_its_inputs_before_the_gates(spark):
    assert "Relation [" not in _plan(JOBS["promotion_metrics"](spark, SMALL)).toString()


def test_outcomes_store_the_histories_asked_for_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(journals, "reliable_checkpoint", lambda df, whole=journals.reliable_checkpoint: seen.append(whole(df)) or seen[-1])
    views = Views(spark, SMALL)
    asked = views.journal_days.where("symbol IN ('1', '2', 'none')")
    out = journals.outcome_calendar_days(asked, views.hist)
    assert {r.ticker for r in seen[0].select("ticker").distinct().collect()} == {"1", "2"}
    assert "l_shipdate" not in _plan(out).toString()
    monkeypatch.setattr(journals, "SENT_NAMES", 0)
    assert sorted(map(str, journals.outcome_calendar_days(asked, views.hist).collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_trailing_measures_equal_windows_bit_by_bit(spark, batch):
    rows = [(k, i, None if (i * 5 + i // 7) % 11 < i % 3 else float((i * 7919 + 31) % 101) / 7) for k in ("a", "b", None) for i in range({"a": 60, "b": 1}.get(k, 25))]
    table = spark.createDataFrame(rows, "ticker string, session_date int, x double")
    measures = (("sd", "x", 21, frames._deviations), ("mean", "x", 5, frames._averages), ("top", "x", 13, frames._maxima), ("mid", "x", 8, frames._medians))
    w = lambda n: Window.partitionBy("ticker").orderBy("session_date").rowsBetween(1 - n, 0)
    want = frames.rolling_medians(table.withColumn("sd", F.stddev_samp("x").over(w(21))).withColumn("mean", F.avg("x").over(w(5))).withColumn("top", F.max("x").over(w(13))), "x", {"mid": (-7, 0)})
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        assert sorted(map(str, frames.trailing(table, measures).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set(size, held)


def test_features_and_their_drift_go_through_each_row_once(spark):
    plan = _plan(JOBS["features"](spark, SMALL)).toString()
    assert "collect_list" not in plan and "stddev_samp" not in plan
    assert "Relation [" not in _plan(JOBS["feature_drift"](spark, SMALL)).toString()


def test_drift_without_a_baseline_is_unknown(spark):
    table = spark.createDataFrame([(d, float(d), None) for d in range(5)], "session_date int, x double, y double")
    got = {r.feature: r for r in scores.feature_drift(table, ["x", "y"], 5).collect()}
    assert {f: r.severity for f, r in got.items()} == {"x": "unknown", "y": "unknown"}
    r = {r.feature: r for r in scores.feature_drift(table, ["x", "y"], 2).collect()}
    assert (r["x"].baseline_mean, r["x"].recent_mean, r["x"].shift, r["y"].severity) == (1.0, 3.5, 2.5, "unknown")


def test_experiments_compute_their_rows_before_folds_and_fits(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(research, "walk_forward_folds", lambda rows, *a, whole=research.walk_forward_folds: seen.append(_plan(rows).toString()) or whole(rows, *a))
    monkeypatch.setattr(research, "calibration_part", lambda rows, *a, whole=research.calibration_part: seen.append(_plan(rows).toString()) or whole(rows, *a))
    JOBS["logistic_challenger"](spark, SMALL)
    assert seen and not [p for p in seen if "Relation [" in p or "l_shipdate" in p]
    days, later = (spark.range(400).select((F.col("id") % 40 + d).alias("session_date"), (F.col("id") % 10).cast("string").alias("ticker"), (F.col("id") % 40 + d + 1).alias("exit_date"),
                                           (F.col("id") % 3 == 0).cast("int").alias("big_move"), F.sin(F.col("id").cast("double")).alias("x")) for d in (0, 5))
    del seen[:]
    got = research.shadow_session(days, later, features=["x"])
    assert got.count() == 10 and "Range" not in seen[0]
