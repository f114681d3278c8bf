"""Queries answer for everything they are asked about: no candidate, column or event of the method is left out."""

from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.catalog.all import JOBS, oracle_texts
from tidemark.operators import events, scores
from tidemark.plans import radar, research

SMALL = "/root/testdata/sf0.001"


def test_a_mover_behind_hundreds_of_refused_ones_is_found(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int"))
    bench = spark.range(30).withColumnRenamed("id", "d").select(day.alias("session_date"), F.lit(100.0).alias("bench_close"))
    jump = F.when(F.col("d") == 29, F.when(F.col("k") < 600, 2.0).otherwise(1.1)).otherwise(1.0)
    bars = spark.range(602).withColumnRenamed("id", "k").crossJoin(spark.range(30).withColumnRenamed("id", "d")).select(
        day.alias("session_date"), F.col("k").cast("string").alias("ticker"), (10.0 * jump).alias("close"), F.lit(1e6).alias("volume"))
    refs = spark.range(602).select(F.col("id").cast("string").alias("ticker"), F.lit("2023-01-01").cast("date").alias("snapshot_date"),
                                   (F.col("id") >= 600).alias("active"), F.lit("CS").alias("raw_type"))
    causes = spark.createDataFrame([("601", "verified", "wire", "https://x", "why")], "ticker string, status string, source string, url string, cause string").withColumn(
        "session_date", F.lit("2024-01-30").cast("date"))
    got = radar.daily_movers(bars, bench, refs, causes, min_sessions=20).orderBy("rank").collect()
    assert [(r.ticker, r.rank, r.direction, r.cause) for r in got] == [("600", 1, "up", None), ("601", 2, "up", "why")]


def test_event_windows_carry_the_interval_and_the_cost_check(spark):
    got = JOBS["event_window_stats"](spark, SMALL)
    assert {"lower95", "upper95", "beats_costs"} <= set(got.columns)
    assert compare(got, connect(SMALL), oracle_texts()["event_window_stats"]) is None
    steady = spark.createDataFrame([(-1, 1, f"2024-01-{1 + i % 25:02}", 2.0 + i % 3) for i in range(120)] + [(0, 1, "2024-01-01", 9.0)],
                                   "entry_offset int, exit_offset int, reaction_date string, excess double")
    many, few = events.event_window_stats(steady).orderBy("entry_offset").collect()
    assert many.beats_costs and 2 <= many.lower95 <= many.mean_excess <= many.upper95 <= 4
    assert (few.sufficient, few.lower95, few.upper95, few.beats_costs) == (False, None, None, False)


def test_digests_of_the_bootstrap_are_taken_once(spark):
    rows = spark.range(40).select((F.col("id") % 10).alias("day"), (F.col("id") % 2).alias("g"), "id")
    plan = scores.cluster_bootstrap(rows, "day", F.col("id"), F.lit(1), by=["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_promotion_carries_the_bound_and_the_failed_gates(spark):
    got = JOBS["promotion_metrics"](spark, SMALL)
    assert {"precision_lower95", "gates"} <= set(got.columns)
    assert compare(got, connect(SMALL), oracle_texts()["promotion_metrics"]) is None
    assert got.first().gates.endswith("incident review;risk review")


def test_model_risk_names_an_empty_archive_and_measures_the_research_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(d, float(d % 2) + (9.0 if d > 19 else 0.0)) for d in range(41)], "session_date int, x double")
    said = rows.select("session_date", F.lit(0.5).alias("p"), (F.col("session_date") % 2).alias("label"))
    got = {(r.source, r.subject): r for r in research.model_risk_events(rows.limit(0), rows, said, ["x"]).collect()}
    assert {k: r.severity for k, r in got.items()} == {("archive", "coverage"): "serious", ("feature", "x"): "serious", ("forecast", "p"): "constant"}
    assert got["feature", "x"].baseline_mean == 0.5 and got["feature", "x"].recent_mean > 9
    assert ("archive", "coverage") not in {(r.source, r.subject) for r in research.model_risk_events(rows, rows, said, ["x"]).collect()}
    seen = []
    monkeypatch.setattr(research, "model_risk_events", lambda *a, whole=research.model_risk_events: seen.append(a) or whole(*a))
    assert JOBS["model_risk_events"](spark, SMALL).columns == ["source", "subject", "baseline_mean", "recent_mean", "shift", "severity"]
    assert "excess_return" in seen[0][1].columns  # rows with an outcome, not every session that has features
