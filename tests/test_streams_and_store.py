"""State that shrinks, order that follows time and not triggers, and tables that are rewritten only where touched."""

import datetime as dt
import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tidemark.sources import store
from tidemark.streaming import state, streams

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def drive(spark, tmp_path, name, make, files, schema, mode="append"):
    """Runs a query over files that arrive one after the other; its rows, and the state rows after each run."""
    source, sizes = str(tmp_path / f"{name}-in"), []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(streams.read_ticks(spark, source, schema))
        sink = stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            q = sink.format("parquet").option("path", str(tmp_path / f"{name}-out")).start()
        else:
            q = sink.foreachBatch(lambda batch, epoch: batch.write.mode("append").parquet(str(tmp_path / f"{name}-out"))).start()
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect(), sizes


CASES = "case_id long, ts timestamp, stage string"
STAGES = ["possible", "developing", "imminent"]


def test_cases_are_judged_in_the_order_of_time(spark, tmp_path):
    # The later event comes in an earlier file; within the delay it still counts as later.
    files = [[(1, hours(5), "imminent"), (2, hours(1), "possible")], [(1, hours(3), "developing"), (1, hours(4), "possible"), (1, hours(6), "developing")], [(9, hours(200), "possible")]]
    rows, _ = drive(spark, tmp_path, "order", lambda s: state.stream_case_stage(s, STAGES, delay="24 hours", idle="1000 hours"), files, CASES)
    got = [(r.ts, r.stage, r.accepted, r.items) for r in sorted(rows, key=lambda r: r.ts) if r.case_id == 1]
    assert got == [(hours(3), "developing", True, 1), (hours(4), "possible", False, 1), (hours(5), "imminent", True, 2), (hours(6), "developing", False, 2)]


def test_idle_cases_close_and_free_their_state(spark, tmp_path):
    files = [[(i, hours(i % 5), "possible") for i in range(50)], [(99, hours(30), "possible")], [(99, hours(300), "possible")], [(99, hours(400), "developing"), (3, hours(399), "imminent")], [(99, hours(500), "possible")]]
    rows, sizes = drive(spark, tmp_path, "idle", lambda s: state.stream_case_stage(s, STAGES, delay="2 hours", idle="100 hours"), files, CASES)
    assert sum(r.closed for r in rows if r.case_id < 50) == 51 - 1 and {r.case_id for r in rows if r.closed} >= set(range(50))
    assert sizes[2] < sizes[1] and sizes[-1] < 10
    again = [(r.stage, r.items) for r in sorted(rows, key=lambda r: (r.ts, r.closed)) if r.case_id == 3 and not r.closed]
    assert again == [("possible", 1), ("imminent", 1)]  # opened anew


TICKS = "symbol string, ts timestamp, price double"


def test_ticks_kept_per_symbol(spark, tmp_path):
    files = [[("A", hours(i), float(i + 1)) for i in range(20)] + [("B", hours(0), 5.0), ("B", hours(1), -1.0)] + [(f"S{i}", hours(0), 1.0) for i in range(8)], [("A", hours(21), 7.0), ("A", hours(21), 8.0), ("A", hours(19), 9.0)], [("C", hours(400), 1.0)], [("C", hours(401), 1.0)]]
    rows, sizes = drive(spark, tmp_path, "kept", lambda s: state.stream_retained(s, most=4, keep="10 hours", delay="5 hours"), files, TICKS, "update")
    last = {}
    for r in rows:
        if r.symbol == "A" and r.times:
            last[r.newest] = list(zip(r.times, r.prices))
    kept = last[hours(21)]
    assert [t for t, _ in kept] == [hours(17), hours(18), hours(19), hours(21)] and kept[2][1] == 20.0 and kept[3][1] in (7.0, 8.0)
    assert {r.symbol for r in rows if not r.times} == {"A", "B", *(f"S{i}" for i in range(8))}  # silent symbols come out empty
    assert sizes[0] == sizes[-1] == 2  # one symbol is left each time: its points and its newest


def test_late_evidence_of_two_queries_stays(spark, tmp_path):
    for name, first, last in (("one", 0, 3), ("two", 3, 5)):
        spark.createDataFrame([(i, hours(i * 10)) for i in range(first, last)], "id long, available_at timestamp").write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema("id long, available_at timestamp").parquet(str(tmp_path / name))
        streams.start_late_evidence(stream, F.lit(hours(25)), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / f"cp-{name}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ok" / "*")).collect()) == [0, 1, 2]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "late" / "*")).collect()) == [3, 4]


def test_latest_versions_of_two_queries(spark, tmp_path):
    for name, rows in (("one", [("A", hours(1), 1.0), ("B", hours(1), 2.0)]), ("two", [("A", hours(2), 3.0)])):
        spark.createDataFrame(rows, TICKS).write.parquet(str(tmp_path / name))
        stream = streams.stream_sessions(streams.read_ticks(spark, str(tmp_path / name), TICKS))
        got = streams.run_to_latest(stream, ["session_date", "symbol"], str(tmp_path / "t"), str(tmp_path / f"cp-{name}"))
    assert sorted((r.symbol, r.last) for r in got.collect()) == [("A", 3.0), ("B", 2.0)]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_batch_reads_and_rewrites_only_what_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "k long, day date, v long"
    rows = [(i, dt.date(2024, 1 + i % 6, 5), i) for i in range(600)]
    first = spark.createDataFrame(rows, schema)
    assert tuple(store.merge_rows(first, path, ["k"], "day", version="v").first()) == (600, 0)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    new = spark.createDataFrame([(7, dt.date(2024, 2, 5), 1000), (7, dt.date(2024, 2, 5), 900), (5000, dt.date(2024, 2, 5), 1)], schema)
    for appended, refused in ((1, 2), (0, 3)):  # brought in again it changes nothing
        assert tuple(store.merge_rows(new, path, ["k"], "day", version="v").first()) == (appended, refused)
        got = {r.k: r.v for r in store.read_store(spark, path, first.schema).collect()}
        assert got == {**{k: v for k, _, v in rows}, 7: 1000, 5000: 1}
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    gone = set(before) - set(after)
    assert 0 < len(gone) <= 2 and all("month=2024-02" in f for f in gone) and all(after[f] == before[f] for f in set(before) & set(after))
    plan = plan_of(store.touched_rows(store.read_store(spark, path, first.schema), [("2024-02", 3), ("2024-02", 5)]))
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert store.merge_rows(new.limit(0), path, ["k"], "day").first().appended == 0


def test_appending_keeps_what_is_stored(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "k long, day date, v long"
    day = dt.date(2024, 3, 1)
    store.merge_rows(spark.createDataFrame([(1, day, 10), (None, None, 3)], schema), path, ["k"], "day", order=["v"])
    counts = store.merge_rows(spark.createDataFrame([(1, day, 5), (2, day, 9), (2, day, 8)], schema), path, ["k"], "day", order=["v"]).first()
    assert tuple(counts) == (1, 2)
    assert {(r.k, r.v) for r in store.read_store(spark, path, spark.createDataFrame([], schema).schema).collect()} == {(1, 10), (2, 8), (None, 3)}


def test_stored_histories_prune_years_and_need_no_exchange(spark, tmp_path):
    from tidemark.operators import frames
    rows = spark.range(6000).select(F.concat(F.lit("T"), (F.col("id") % 40).cast("string")).alias("ticker"), F.date_add(F.lit(dt.date(2019, 1, 1)), (F.col("id") / 4).cast("int")).alias("session_date"),
                                    (F.col("id") % 17 + 1).cast("double").alias("close"), F.lit(10.0).alias("volume"))
    name = store.write_history(rows, store.scratch_name("bars"), str(tmp_path / "bars"), buckets=8)
    try:
        cut = store.scan_history(spark, name, "2020-03-01", "2021-02-28")
        want = rows.where("session_date BETWEEN '2020-03-01' AND '2021-02-28'")
        assert sorted(map(tuple, cut.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        filters = plan_of(cut).split("PartitionFilters: [")[1].split("\n")[0]
        assert "year" in filters and "2020" in filters
        windowed = frames.prior_sessions(store.scan_history(spark, name))
        assert "Exchange" not in plan_of(windowed).split("== Initial Plan ==")[-1]
        assert windowed.select("ticker", "session_date", "prior_sessions").exceptAll(frames.prior_sessions(rows).select("ticker", "session_date", "prior_sessions")).count() == 0
        other = store.write_history(rows.withColumn("close", F.col("close") * 2), store.scratch_name("bars"), str(tmp_path / "other"), buckets=8)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        joined = store.scan_history(spark, name).hint("merge").join(store.scan_history(spark, other).select("ticker", "session_date", F.col("close").alias("other")), ["ticker", "session_date"])
        assert "Exchange" not in plan_of(joined).split("== Initial Plan ==")[-1] and joined.where("other = 2 * close").count() == rows.count()
        spark.sql(f"DROP TABLE {other}")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    finally:
        spark.sql(f"DROP TABLE {name}")
