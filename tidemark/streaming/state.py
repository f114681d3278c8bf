"""Streams with state of their own per key, on the RocksDB state store with timers.

State lives beside the executors in RocksDB and is checkpointed with the query, so a lost executor's keys are restored elsewhere.
Timers run on the watermark: an event is acted on once nothing earlier can arrive any more, whatever trigger brought it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Timers and several state variables need this store; a provider that the session names itself is left alone."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def stream_case_stage(events: DataFrame, stages: list[str], key="case_id", ts="ts", delay="1 day", idle="30 days") -> DataFrame:
    """Stage of every case as events arrive: (key, stage, ts, accepted, items, closed).

    Events wait in the state until the watermark has passed them and are then judged in the order of their time, so what comes out is
    what one pass over all events in order would say. An event that would move a case backwards is rejected and changes nothing. A case
    without an event for ``idle`` is closed: one row with ``closed`` set, and its state is freed; a later event opens it anew. State per
    case is one position, one counter and the events of the last ``delay``. Events later than the watermark are dropped.
    """
    spark = events.sparkSession
    with_rocksdb(spark)
    place = {s: i for i, s in enumerate(stages)}
    wait = int(spark.range(1).select((F.expr(f"unix_micros(TIMESTAMP '1970-01-01' + INTERVAL {idle})")).alias("n")).first().n) // 1000

    class Case(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.case = handle.getValueState("case", "at int, items long, last long")
            self.waiting = handle.getListState("waiting", "us long, stage string")

        def handleInputRows(self, key, rows, timerValues):
            new = [(int(us), stage) for batch in rows for us, stage in zip(batch["micros"].tolist(), batch["stage"].tolist())]
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(us for us, _ in new) // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark, out = timerValues.getCurrentWatermarkInMs(), []
            events = sorted(self.waiting.get())
            due, rest = [e for e in events if -(-e[0] // 1000) <= mark], [e for e in events if -(-e[0] // 1000) > mark]
            at, items, last = self.case.get() if self.case.exists() else (-1, 0, None)
            for us, stage in due:
                if last is not None and us // 1000 - last > wait:  # it lay idle before this event
                    out.append((key[0], None, last * 1000, None, items, True))
                    at, items = -1, 0
                ok = place.get(stage, -1) >= max(at, 0)
                if ok:
                    at, items = place[stage], items + 1
                last = us // 1000
                out.append((key[0], stage, us, ok, items, False))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            else:
                self.waiting.clear()
            if last is not None and not rest and last + wait < mark:
                self.case.clear()
                out.append((key[0], None, last * 1000, None, items, True))
            elif last is not None:
                self.case.update((at, items, last))
                self.handle.registerTimer(last + wait + 1)
            if out:
                yield pd.DataFrame(out, columns=["key", "stage", "us", "accepted", "items", "closed"])

        def close(self):
            pass
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, delay).select(F.col(key).alias("case_key"), "stage", F.unix_micros(ts).alias("micros"), ts)
    out = rows.groupBy("case_key").transformWithStateInPandas(Case(), f"key {kind}, stage string, us long, accepted boolean, items long, closed boolean", "Append", "EventTime")
    return out.select(F.col("key").alias(key), "stage", F.timestamp_micros("us").alias(ts), "accepted", "items", "closed")


def stream_retained(ticks: DataFrame, key="symbol", ts="ts", price="price", most: int = 300, keep="3 days", delay="1 hour") -> DataFrame:
    """The ticks of each symbol that are kept, whenever they change: (key, newest, times, prices), oldest first.

    Of each symbol the last ``most`` instants stay, none older than ``keep`` before its newest; of ticks at one instant the first to arrive
    stays, and prices of zero and less are no ticks. A symbol without a tick for ``keep`` behind the watermark comes out empty and its state is freed. State per
    symbol is at most ``most`` points. Rows are cut to that many per symbol and task before they meet.
    """
    spark = ticks.sparkSession
    with_rocksdb(spark)
    span = int(spark.range(1).select((F.expr(f"unix_micros(TIMESTAMP '1970-01-01' + INTERVAL {keep})")).alias("n")).first().n)

    class Kept(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.points = handle.getListState("points", "us long, price double")
            self.newest = handle.getValueState("newest", "us long")

        def handleInputRows(self, key, rows, timerValues):
            kept = dict(self.points.get())
            before = len(kept), max(kept, default=None)
            for batch in rows:
                for us, value in zip(batch["micros"].tolist(), batch["price"].tolist()):
                    kept.setdefault(int(us), float(value))
                if len(kept) > 4 * most:
                    kept = dict(sorted(kept.items())[-most:])
            newest = max(kept)
            kept = [(us, value) for us, value in sorted(kept.items())[-most:] if us >= newest - span]
            self.points.put(kept)
            if before != (len(kept), newest) or before[1] is None:
                if self.newest.exists():
                    self.handle.deleteTimer((self.newest.get()[0] + span) // 1000 + 1)
                self.newest.update((newest,))
                self.handle.registerTimer((newest + span) // 1000 + 1)
            yield pd.DataFrame({"key": [key[0]], "newest": [newest], "times": [[us for us, _ in kept]], "prices": [[value for _, value in kept]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            newest = self.newest.get()[0]
            self.points.clear()
            self.newest.clear()
            yield pd.DataFrame({"key": [key[0]], "newest": [newest], "times": [[]], "prices": [[]]})

        def close(self):
            pass
    kind = dict(ticks.dtypes)[key]
    rows = ticks.where(F.col(price) > 0).withWatermark(ts, delay).select(F.col(key).alias("case_key"), F.unix_micros(ts).alias("micros"), F.col(price).cast("double").alias("price"), ts)
    out = rows.groupBy("case_key").transformWithStateInPandas(Kept(), f"key {kind}, newest long, times array<long>, prices array<double>", "Update", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("newest").alias("newest"), F.transform("times", lambda t: F.timestamp_micros(t)).alias("times"), "prices")
