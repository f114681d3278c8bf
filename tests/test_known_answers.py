"""Small archives with answers known in advance, and the properties every job must keep."""

import datetime as dt
import html
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import deals, text
from tidemark.operators import frames, joins, scores, sets
from tidemark.operators.quantiles import exact_median
from tidemark.plans import fundamentals, observations, research
from tidemark.sources import documents
from tidemark.sources.bars import scan_histories

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def test_dividend_scales_earlier_close_only(spark):
    bars = spark.createDataFrame([("X", day(0), 100.0), ("X", day(1), 99.0)], "ticker string, session_date date, close double")
    cash = spark.createDataFrame([("X", day(1), 1.0)], "ticker string, event_date date, cash double")
    got = {r["session_date"]: r["adjusted_close"] for r in frames.total_return_adjust(bars, cash).collect()}
    assert got == {day(0): 99.0, day(1): 99.0}


def test_dividend_after_the_last_bar_scales_every_bar_and_a_bad_one_blanks_them(spark):
    bars = spark.createDataFrame([("X", day(0), 100.0), ("Y", day(0), 100.0)], "ticker string, session_date date, close double")
    cash = spark.createDataFrame([("X", day(5), 10.0), ("Y", day(5), 200.0)], "ticker string, event_date date, cash double")
    got = {r["ticker"]: r["adjusted_close"] for r in frames.total_return_adjust(bars, cash).collect()}
    assert got["X"] == pytest.approx(90.0) and got["Y"] is None


def test_forward_label_threshold_and_quarantine(spark):
    df = spark.createDataFrame([(100.0, 111.0, 100.0, 100.0, True), (100.0, 105.0, 100.0, 100.0, True), (100.0, 150.0, 100.0, 100.0, False)], "a double, b double, c double, d double, ok boolean")
    lab = observations.forward_label(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 1, F.col("ok"))
    assert [(r[0]["status"], r[0]["direction"]) for r in df.select(lab).collect()] == [("ready", "up"), ("ready", "none"), ("quarantined", None)]


def test_features_do_not_see_later_sessions(spark):
    rng = np.random.default_rng(3)
    rows = [("X", day(i), float(100 + rng.normal()), float(100 + rng.normal()), float(1e6 + i), True) for i in range(150)]
    schema = "ticker string, session_date date, close double, bench_close double, dollar_volume double, clean boolean"
    whole = frames.features(scan_histories(spark.createDataFrame(rows, schema))).filter(F.col("session_date") <= F.lit(day(99)))
    part = frames.features(scan_histories(spark.createDataFrame(rows[:100], schema)))
    drop = ["n"]
    assert sorted(map(str, whole.drop(*drop).collect())) == sorted(map(str, part.drop(*drop).collect()))


def test_bucketed_asof_equals_plain_asof_on_one_hot_key(spark):
    rng = np.random.default_rng(1)
    left = [("hot" if i % 3 else f"k{i}", i, day(int(rng.integers(0, 900)))) for i in range(600)]
    right = [("hot" if i % 2 else f"k{i}", i, day(int(rng.integers(0, 900)))) for i in range(400)]
    l, r = spark.createDataFrame(left, "k string, id int, t date"), spark.createDataFrame(right, "k string, rid int, u date")
    for kw in ({}, {"strict": True}, {"forward": True}, {"forward": True, "strict": True}):
        a = joins.asof_join(l, r, "k", "t", "u", ["rid"], tie=["rid"], **kw).collect()
        b = joins.asof_join(l, r, "k", "t", "u", ["rid"], tie=["rid"], bucket_days=7, **kw).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
        want = {}
        for k, i, t in left:
            ok = [(u, j) for kk, j, u in right if kk == k and ((u > t if kw.get("strict") else u >= t) if kw.get("forward") else (u < t if kw.get("strict") else u <= t))]
            near = (min if kw.get("forward") else max)((u for u, _ in ok), default=None)
            want[i] = max((j for u, j in ok if u == near), default=None)
        assert {x["id"]: x["rid"] for x in b} == want


def test_top_n_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    got = sets.latest_n_per_key(df, ["k"], [F.desc("id")], 4).filter("k = 'hot'").orderBy("rank").select("id").collect()
    assert [r["id"] for r in got] == [4998, 4995, 4992, 4989]


def test_append_twice_adds_nothing(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    first = sets.append_if_absent(new, new.limit(0), ["k"], ["v"])
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 5)]
    assert sets.append_if_absent(new, first, ["k"], ["v"]).count() == 0


def test_global_position_is_dense_under_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("v"), "id")
    got = sorted((r["position"], r["v"], r["id"]) for r in sets.global_position(df, ["v", "id"]).collect())
    assert [p for p, _, _ in got] == list(range(1000)) and [(v, i) for _, v, i in got] == sorted((v, i) for _, v, i in got)


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([("g", float(x)) for x in values], "g string, v double")
    assert exact_median(df, ["g"], "v", accuracy=100).first()["median"] == np.median(values)


def test_distributed_and_local_fits_agree(spark):
    df = spark.range(400).select(((F.col("id") % 9 + 0.5) / 10).alias("p"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    a, b = scores.calibration_slope(df).first(), scores.calibration_slope(df, small=0).first()
    assert a["slope"] == pytest.approx(b["slope"]) and a["intercept"] == pytest.approx(b["intercept"])


def test_folds_expand_keep_the_gap_and_never_overlap(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(100)], "session_date date")
    f = research.walk_forward_folds(dates, 5, 3).orderBy("fold").collect()
    assert len(f) == 3
    for a in f:
        assert (a["test_start"] - a["train_end"]).days == 6 and a["train_start"] == day(0)
    assert all(x["test_end"] < y["test_start"] for x, y in zip(f, f[1:]))


def test_calibration_quarter_is_the_latest(spark):
    rows = [(day(i // 10), f"t{i % 10}", i) for i in range(300)]
    got = research.calibration_part(spark.createDataFrame(rows, "session_date date, ticker string, i int"))
    assert sorted(r["i"] for r in got.filter("calibrate").collect()) == list(range(225, 300))


def test_ttm_bridge_appears_on_its_filing_day_only(spark):
    facts = [("E", "cfo", D(2024, 1, 1), D(2024, 12, 31), 100.0, D(2025, 2, 1), "10-K", "a"), ("E", "cfo", D(2025, 1, 1), D(2025, 6, 30), 70.0, D(2025, 7, 20), "10-Q", "b"),
             ("E", "cfo", D(2024, 1, 1), D(2024, 6, 30), 40.0, D(2025, 7, 20), "10-Q", "b")]
    df = spark.createDataFrame(facts, "entity string, metric string, start date, end date, val double, filed date, form string, accn string")
    asks = spark.createDataFrame([("E", "cfo", D(2025, 7, 19)), ("E", "cfo", D(2025, 7, 20)), ("E", "cfo", D(2025, 1, 1))], "entity string, metric string, as_of date")
    got = {r["as_of"]: (r["ttm"], r["method"]) for r in fundamentals.ttm_as_of(df, asks).collect()}
    assert got == {D(2025, 7, 19): (100.0, "annual"), D(2025, 7, 20): (130.0, "bridge")}


def test_visible_text_equals_the_standard_parser(spark):
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts = []

        def handle_data(self, data):
            self.parts.append(data)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", text.html_to_text("html").alias("t")).collect()
    for r in pages:
        p = Text()
        p.feed(r["html"])
        assert r["t"] == re.sub(r"\s+", " ", html.unescape(" ".join(p.parts))).strip()


def test_guidance_ranges(spark):
    lines = ["Management expects full-year 2026 revenue of $10 billion USD to $12 billion USD.", "We expect Q3 2026 gross margin of 47% to 49%.", "Management expects revenue of approximately $11 billion.",
             "Management expects FY 2026 revenue of $10 billion to $12 billion.", "Management expects FY 2026 revenue of $10 billion USD to $12 billion USD, with a midpoint of $11 billion USD.", "We expect FY 2026 organic revenue of 1 USD to 2 USD."]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, text string")
    got = {r["k"]: r for r in text.extract_guidance(df).collect()}
    assert (got[0]["low"], got[0]["high"], got[0]["currency"], got[0]["midpoint"]) == (1e10, 1.2e10, "USD", None)
    assert (got[1]["unit"], got[1]["currency"], got[1]["quarter"]) == ("percent", None, "3")
    assert got[2]["verdict"] == got[3]["verdict"] == "rejected" and got[4]["midpoint"] == 1.1e10 and 5 not in got


def test_merger_terms(spark):
    lines = {"cash": "Issuer SEC CIK: 1. The merger completed on June 2, 2025. Each share was converted into the right to receive 150 USD in cash per share.",
             "stock": "Issuer SEC CIK: 1. The merger became effective on June 2, 2025. Each share became 0.5 shares for each share. Successor security identity: FIGI:NEW.",
             "unclear": "Issuer SEC CIK: 1. The merger completed on June 2, 2025. Holders receive 150 USD per share and 155 USD per share.", "other": "Issuer SEC CIK: 2. The merger completed on June 2, 2025. Holders receive 150 USD per share."}
    df = spark.createDataFrame([(k, "CIK:1", t) for k, t in lines.items()], "k string, target_id string, text string")
    got = {r["k"]: (r["status"], r["kind"] or r["reason"]) for r in deals.terminal_terms(df).collect()}
    assert got == {"cash": ("accepted", "cash"), "stock": ("accepted", "stock"), "unclear": ("rejected", "ambiguous terms"), "other": ("rejected", "target identity")}


def test_options_and_broken_filings_are_left_out(spark):
    row = "<infoTable><nameOfIssuer>A</nameOfIssuer><titleOfClass>COM</titleOfClass><cusip>c1</cusip><value>{v}</value><shrsOrPrnAmt><sshPrnamt>{s}</sshPrnamt></shrsOrPrnAmt>{p}</infoTable>"
    xml = "<informationTable>" + row.format(v=1000, s=100, p="") + row.format(v=500, s=50, p="") + row.format(v=9, s=9, p="<putCall>Put</putCall>") + "</informationTable>"
    df = spark.createDataFrame([("f", xml), ("bad", "<informationTable><oops")], "k string, xml string")
    got = documents.parse_13f(df).groupBy("cusip").agg(F.sum("shares").alias("s"), F.sum("value").alias("v")).collect()
    assert [tuple(r) for r in got] == [("C1", 150.0, 1500.0)]
