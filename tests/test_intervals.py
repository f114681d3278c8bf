"""Unions of intervals against sets of days, and certification of sessions whose action requests leave a gap."""

import datetime as dt
import random


from tidemark.operators import intervals
from tidemark.plans import observations

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_union_equals_sets_of_days(spark):
    rng = random.Random(4)
    rows = [(k, day(a), day(a + rng.randint(-2, 9))) for k in "abc" for a in (rng.randint(0, 120) for _ in range(25))] + [("a", None, day(3)), ("a", day(3), None), ("d", day(9), day(2))]
    got = intervals.interval_union(spark.createDataFrame(rows, "k string, start date, end date"), ["k"]).collect()
    days = {k: {day(i) for _, s, e in ((r[0], r[1], r[2]) for r in rows if r[0] == k and r[1] and r[2]) for i in range((s - D0).days, (e - D0).days + 1)} for k in "abcd"}
    for k in "abcd":
        mine = sorted((r.start, r.end) for r in got if r.k == k)
        assert {day(i) for s, e in mine for i in range((s - D0).days, (e - D0).days + 1)} == days[k]
        assert all((b[0] - a[1]).days > 1 for a, b in zip(mine, mine[1:]))


def test_ranges_lie_inside_one_island(spark):
    islands = spark.createDataFrame([("a", day(0), day(10)), ("a", day(12), day(20))], "k string, start date, end date")
    asked = spark.createDataFrame([(i, "a", day(s), day(e)) for i, (s, e) in enumerate([(0, 10), (5, 12), (12, 12), (11, 11), (0, 20)])] + [(9, "b", day(1), day(2))], "i int, k string, f date, l date")
    got = {r.i: r.inside for r in intervals.within_islands(asked, islands, ["k"], "f", "l", "inside").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 9: False}


def _requests(spark, rows):
    at = dt.datetime(2019, 1, 1)
    return spark.createDataFrame([(e, day(s), day(z), when or at, h, f"{e}{s}") for e, s, z, when, h in rows], "endpoint string, actions_start date, actions_end date, retrieved_at timestamp, content_hash string, request_id string")


def test_sessions_in_a_gap_are_blocked(spark):
    sha = "a" * 64
    requests = _requests(spark, [("splits", 0, 40, None, sha), ("dividends", 0, 9, None, sha), ("dividends", 20, 40, None, sha), ("dividends", 10, 12, dt.datetime(2021, 1, 1), sha), ("dividends", 13, 15, None, "short"), ("mergers", 0, 40, None, sha)])
    asks = spark.createDataFrame([(day(i), t, dt.datetime(2020, 6, 1)) for i in (5, 11, 14, 18, 25) for t in ("A", "B")] + [(day(5), "A", dt.datetime(2020, 6, 1))], "session_date date, ticker string, cutoff timestamp")
    bars = spark.createDataFrame([(t, day(i), 1.0, True, dt.datetime(2020, 2, 1), sha) for i in range(40) for t in ("A", "B") if (i, t) != (25, "B")], "ticker string, session_date date, close double, adjusted boolean, fetched_at timestamp, raw_sha256 string")
    refs = spark.createDataFrame([("A", day(0), True, "S1", "C1", "1", dt.datetime(2020, 1, 2), sha), ("B", day(0), True, None, None, "7", dt.datetime(2020, 1, 2), sha)],
                                 "ticker string, snapshot_date date, active boolean, share_class_figi string, composite_figi string, cik string, fetched_at timestamp, raw_sha256 string")
    sessions = spark.createDataFrame([(day(i), "complete", True, dt.datetime(2020, 2, 1)) for i in range(40)], "session_date date, status string, adjusted boolean, fetched_at timestamp")
    found = observations.certify_sessions(asks, bars, refs, sessions, requests).cache()
    assert {r.session_date: (r.status, list(r.failures)) for r in found.collect()} == {
        day(5): ("ready", []), day(11): ("blocked", ["action coverage"]), day(14): ("blocked", ["action coverage"]), day(18): ("blocked", ["action coverage"]), day(25): ("blocked", ["close"])}
    members = {(r.ticker, r.security_id, r.included) for r in observations.certified_members(asks, bars, refs, found).collect()}
    assert members == {("A", "FIGI:S1", True), ("B", "CIK:7", True)}
    evidence = sorted((r.category, r.record_key, len(r.content_hashes)) for r in observations.certified_evidence(asks, bars, refs, found).collect())
    assert evidence == [("archived_adjusted_close", f"A:{day(5)}", 1), ("archived_adjusted_close", f"B:{day(5)}", 1), ("corporate_action_coverage", str(day(5)), 2)]


def test_a_gap_or_a_short_tail_spoils_observations(spark):
    sha = "a" * 64
    bars = spark.createDataFrame([("A", day(i), 10.0 + i) for i in range(10)], "ticker string, session_date date, close double")
    def covered(rows):
        return observations.action_range(bars, _requests(spark, rows)).select("covered.*").first()
    both = lambda *spans: [(e, s, z, None, sha) for e in ("splits", "dividends") for s, z in spans]
    assert tuple(covered(both((0, 4), (5, 30)))) == (True, True)
    assert tuple(covered(both((0, 4), (6, 30)))) == (False, False)
    assert tuple(covered(both((0, 22)))) == (True, False)
    assert tuple(covered(both((0, 30))[:1])) == (False, False)
