"""Set operations, top-k and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint


def union_aliases(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def union_universe(lists: list[DataFrame], key="symbol", ordinal="ordinal") -> DataFrame:
    """Distinct union that keeps the first position at which a symbol appears: by list, then inside the list."""
    out = None
    for i, f in enumerate(lists):
        part = f.select(key, F.lit(i).alias("list"), F.col(ordinal).alias(ordinal))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(key).agg(F.min(F.struct("list", ordinal)).alias("f"))
    return first.select(key, F.col("f.list").alias("list"), F.col(f"f.{ordinal}").alias(ordinal))


def common_months(returns: DataFrame, key="symbol", month="month") -> DataFrame:
    """Months present for every symbol."""
    n = returns.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    per = returns.groupBy(month).agg(F.count_distinct(key).alias("_k"))
    return per.join(n, per["_k"] == n["_n"]).select(month)


def except_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def union_evidence(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_if_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; of several with one key the first by ``order`` is taken."""
    first = F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                           *[F.col(c) for c in new.columns if c not in order])).alias("_f")
    one = new.groupBy(*keys).agg(first)
    names = {o: f"_o{i}" for i, o in enumerate(order)}
    one = one.select(*[F.col(f"_f.{names.get(c, c)}").alias(c) for c in new.columns])
    return one.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def append_counts(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys an append would add and how many rows it would refuse."""
    per = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    mark = existing.select(*keys).distinct().withColumn("_stored", F.lit(1))
    stored = F.col("_stored").isNotNull()
    return per.join(mark, keys, "left").agg(
        F.coalesce(F.sum(F.when(stored, 0).otherwise(1)), F.lit(0)).alias("appended"),
        F.coalesce(F.sum(F.when(stored, F.col("_n")).otherwise(F.col("_n") - 1)), F.lit(0)).alias("refused"))


def upsert_latest(new: DataFrame, existing: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the highest version; partial aggregation keeps a hot key cheap."""
    both = existing.unionByName(new)
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), version).alias("_b"))
    return best.select(*keys, "_b.*").select(*both.columns)


def freeze_once(result: DataFrame, stored: DataFrame, period: str) -> DataFrame:
    """The stored rows of every frozen period, plus the result of periods not frozen yet."""
    return stored.unionByName(result.join(stored.select(period).distinct(), period, "left_anti").select(*stored.columns))


def latest_n_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each key by a total order (the feature is a top-n report).

    A salted first pass keeps ``n`` rows per (key, salt), so a key with most of the rows is cut down in parallel before
    its survivors meet in one window.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64)).alias("_salt")
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
    final = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n).drop("_salt", "_rn")


def latest_session_rows(df: DataFrame, eligible="eligible", ts="session_date") -> DataFrame:
    """Rows of the newest session that has an eligible row."""
    last = df.filter(F.col(eligible)).agg(F.max(ts).alias(ts))
    return df.filter(F.col(eligible)).join(last, ts, "left_semi")


def downsample_minmax(df: DataFrame, limit: int = 360, key="ticker", ts="session_date", value="close") -> DataFrame:
    """At most about ``limit`` points per key: the ends, and the low and high of each interior bucket.

    The bucket comes from the row's position; lows and highs are aggregates, so the result does not depend on ties of
    value: the earliest low and the earliest high are kept.
    """
    w = Window.partitionBy(key).orderBy(ts)
    pos = df.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    size = F.greatest(F.lit(1), F.ceil((F.col("_n") - 2) / F.lit(max(1, (limit - 2) // 2))))
    inner = (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)
    pos = pos.withColumn("_b", F.when(~inner, F.lit(-1)).otherwise(
        F.floor((F.col("_i") - 1) / size)))
    ends = pos.filter((F.col("_b") < 0) | (F.col("_n") <= limit)).select(key, ts, value)
    mid = pos.filter((F.col("_b") >= 0) & (F.col("_n") > limit)).groupBy(key, "_b").agg(
        F.min(F.struct(value, ts)).alias("lo"),
        F.min(F.struct((-F.col(value)).alias("neg"), F.col(ts), F.col(value))).alias("hi"))
    picked = mid.select(key, F.explode(F.array(
        F.struct(F.col(f"lo.{ts}").alias(ts), F.col(f"lo.{value}").alias(value)),
        F.struct(F.col(f"hi.{ts}").alias(ts), F.col(f"hi.{value}").alias(value)))).alias("p")).select(key, "p.*")
    return ends.unionByName(picked).distinct()


def chrono_sort(df: DataFrame, ts="session_date", key="ticker") -> DataFrame:
    """Total order by (session, ticker): range partitioning, then a sort inside each partition."""
    return df.repartitionByRange(ts, key).sortWithinPartitions(ts, key)


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position in a total order over the whole table without a single-task sort.

    Rows are range-partitioned on the full order (ties are split by its last, unique column), each range is ranked on
    its own, and the sizes of the ranges before are added. The ranged table is checkpointed so that ranks and range
    sizes always come from the same split, even when an executor is lost in between.
    """
    ranged = reliable_checkpoint(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return (ranged.withColumn("_rank", rank).join(sizes, "_pid")
            .withColumn(name, F.col("_rank") + F.col("_before")).drop("_pid", "_rank", "_before"))


def alert_budget(alerts: DataFrame, budget: int = 5, session="session_date", probability="p", tie: str = "ticker",
                 status="status") -> DataFrame:
    """Per session the ``budget`` likeliest alerts stay; the rest become abstentions with a reason.

    The cut is found first: a salted top-``budget`` gives each session's last admitted (probability, tie), and every row
    is compared with it, so no window ever holds a whole session.
    """
    live = alerts.filter(F.col(status) != "abstain")
    top = latest_n_per_key(live.select(session, probability, tie), [session], [F.desc(probability), F.asc(tie)], budget)
    keep = top.select(session, tie).withColumn("_keep", F.lit(True))
    out = alerts.join(keep, [session, tie], "left")
    over = (F.col(status) != "abstain") & F.col("_keep").isNull()
    return (out.withColumn("budget_reason", F.when(over, "daily alert budget reached"))
            .withColumn(status, F.when(over, "abstain").otherwise(F.col(status))).drop("_keep"))
