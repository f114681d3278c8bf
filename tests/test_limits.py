"""Cases at the edges: long paths, odd character references, repeated appends, stages out of order, chains, many assets."""

import datetime as dt
import html

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import portfolio, quantiles
from tidemark.plans import journals, ledger
from tidemark.streaming import streams


def test_a_path_of_600_sessions_has_its_drawdown(spark):
    start = dt.date(2020, 1, 1)
    rows = [("A", start + dt.timedelta(days=i), 100.0 - (40.0 if i == 555 else 0.0), 50.0, True) for i in range(1200)]
    hist = spark.createDataFrame(rows, "ticker string, session_date date, close double, bench_close double, clean boolean")
    asks = spark.createDataFrame([("A", start, 600), ("A", start, 30)], "symbol string, decision_date date, horizon_days int")
    got = {r.horizon_days: r for r in journals.outcome_calendar_days(asks, hist).collect()}
    assert (got[600].status, got[600].sessions_held, round(got[600].max_drawdown, 6)) == ("matured", 599, -40.0)
    assert round(got[30].max_drawdown, 6) == 0.0


def test_character_references_follow_the_standard(spark):
    pages = ["a &#128; b", "&#0;", "&#9999999;", "&#xD800;", "&copy 2024", "&notit; &notin; &amp;lt; &AMP &amp", "&#x1F600; &#128512", "&#00000000065; &#x000041;", "&unknown; & &; &#; &#x;",
             "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#1;&#127;&#xFDD0;&#xFFFF;x", "no reference", "", "&lt;b&gt;&nbsp;&eacute;&eacute"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", text.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: html.unescape(p) for i, p in enumerate(pages)}
    assert df.select(text.html_to_text("t").alias("u")).count() == len(pages)


def test_appends_of_two_queries_keep_all_rows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for first, last, name in ((0, 3, "one"), (2, 5, "two")):
        spark.range(first, last).withColumn("v", F.col("id") * 10).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, v long").parquet(source)
        streams.start_append(stream, path, str(tmp_path / name), ["id"], ["v"]).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{path}/*").collect()) == list(range(last))


def test_an_earlier_failure_does_not_bind_a_later_snapshot(spark):
    day = dt.date
    snaps = spark.createDataFrame([(1, day(2020, 1, 1), "P", False, True), (2, day(2021, 1, 1), "P", True, True), (3, day(2022, 1, 1), "P", True, True)],
                                  "snapshot_id int, decision_date date, policy string, policy_frozen boolean, prices_point_in_time boolean")
    members = spark.createDataFrame([(i, "A", True, True) for i in (1, 2, 3)], "snapshot_id int, security_id string, included boolean, membership_verified boolean")
    outcomes = spark.createDataFrame([(i, "A", "complete", day(2024, 1, 1), "cash", "USD", i, i) for i in (1, 2, 3)],
                                     "snapshot_id int, security_id string, status string, valid_through date, kind string, currency string, recorded_at int, outcome_id int")
    got = {r.snapshot_id: r.status for r in ledger.build_protocol(members, outcomes, snaps).collect()}
    assert got == {1: "accumulating", 2: "ready", 3: "ready"}


def test_inactive_and_resolved_members_are_kept(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, "A", "a", False, "resolved", True, t, t, True), (1, "B", "b", None, "verified", True, t, t, True), (1, "C", "c", True, "open", False, None, t, False)]
    members = spark.createDataFrame(rows, "snapshot_id int, security_id string, ticker string, active boolean, identity_status string, membership_verified boolean, identity_available_at timestamp, cutoff timestamp, included boolean")
    evidence = spark.createDataFrame([(1, "A", "x", t + dt.timedelta(days=1), t)], "snapshot_id int, security_id string, payload string, available_at timestamp, cutoff timestamp")
    got = ledger.capture_snapshot(members, evidence).first()
    assert (got.members, got.included, got.evidence, got.late_evidence, got.status) == (3, 1, 0, 1, "refused")


def test_co_movement_over_several_blocks(spark):
    rng = np.random.default_rng(8)
    x = 1000 + rng.standard_normal((50, 150))
    rows = [(f"S{j:03d}", i, float(x[i, j])) for i in range(50) for j in range(150) if (i + j) % 7]
    got = portfolio.pairwise_stats(spark.createDataFrame(rows, "symbol string, session_date int, ret double"), minimum=10).collect()
    assert len(got) == 150 * 150
    there = {(r.left, r.right): r for r in got}
    for a, b in ((0, 149), (70, 3), (5, 5), (64, 63)):
        days = [i for i in range(50) if (i + a) % 7 and (i + b) % 7]
        assert there[f"S{a:03d}", f"S{b:03d}"].observations == len(days)
        assert abs(there[f"S{a:03d}", f"S{b:03d}"].correlation - np.corrcoef(x[days, a], x[days, b])[0, 1]) < 1e-9


def test_assets_without_a_common_date_keep_their_places(spark):
    """A and C never meet: every other correlation and covariance still belongs to its own pair."""
    rng = np.random.default_rng(4)
    days = {"A": range(0, 60), "B": range(0, 120), "C": range(60, 120), "D": range(0, 120)}
    x = {s: {d: float(rng.standard_normal()) for d in r} for s, r in days.items()}
    returns = spark.createDataFrame([(s, d, v) for s, r in x.items() for d, v in r.items()], "symbol string, session_date int, ret double")
    weights = {"A": 10.0, "B": 20.0, "C": 30.0, "D": 40.0}
    table = spark.createDataFrame([("P", s, w) for s, w in weights.items()], "portfolio string, symbol string, weight double")

    def both(a, b):
        at = sorted(set(days[a]) & set(days[b]))
        return [x[a][d] for d in at], [x[b][d] for d in at]
    got = {r.symbol: r.average_correlation for r in portfolio.average_correlation(table, portfolio.pairwise_stats(returns), list(days)).collect()}
    for s in days:
        known = [(weights[o], np.corrcoef(*both(s, o))[0, 1]) for o in days if o != s and both(s, o)[0]]
        assert abs(got[s] - sum(w * c for w, c in known) / sum(w for w, _ in known)) < 1e-9
    pairs = [(a, b) for a in days for b in days if both(a, b)[0]]
    assert len(pairs) == 14
    want = sum(weights[a] * weights[b] / 1e4 * np.cov(*both(a, b))[0, 1] for a, b in pairs)
    cov = portfolio.covariance(returns, shrink=0.0, ts="session_date")
    assert abs(portfolio.portfolio_variance(table, cov, list(days)).first().variance - want) < 1e-9


def test_medians_are_exact_where_the_sketch_is_coarse(spark):
    rows = [(k, float((i * 7919) % 1001)) for k in range(3) for i in range(1001 + k)]
    got = {r.k: r.median for r in quantiles.exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", accuracy=50).collect()}
    assert got == {k: float(np.median([v for q, v in rows if q == k])) for k in range(3)}
