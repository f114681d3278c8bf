"""As-of, nearest, calendar and identity joins.

As-of joins never compare rows pairwise. Both sides are unioned, ordered in time and filled forward by a window. When a
key may be arbitrarily large the work is split into time buckets: each (key, bucket) is its own window partition and
starts from a carry row that summarises all earlier buckets, so one hot key spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _instant(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _fill(left: DataFrame, right: DataFrame, keys: list[str], left_order: Column, right_order: Column, payload: Column,
          right_first: bool, latest: bool, bucket: int | None) -> DataFrame:
    """Attach to each left row the payload of the last (or, without ``latest``, the greatest) right row before it."""
    left_row = left.select(*keys, left_order.alias("_o"), F.lit(1).alias("_side"), F.struct("*").alias("_l"))
    right_row = right.filter(right_order.isNotNull()).select(
        *keys, right_order.alias("_o"), F.lit(0 if right_first else 2).alias("_side"), payload.alias("_r"))
    null_l = F.lit(None).cast(left_row.schema["_l"].dataType)
    null_r = F.lit(None).cast(right_row.schema["_r"].dataType)
    rows = left_row.withColumn("_r", null_r).unionByName(right_row.withColumn("_l", null_l))
    part = list(keys)
    if bucket:
        part.append("_b")
        slot = F.floor(F.col("_o") / bucket).alias("_b")
        rows = rows.withColumn("_b", slot)
        best = F.max("_r") if not latest else F.max_by("_r", F.struct("_o", "_r"))
        per = (right_row.groupBy(*keys, slot).agg(best.alias("_r"))
               .unionByName(left_row.select(*keys, slot).distinct().withColumn("_r", null_r)))
        per = per.groupBy(*part).agg(F.max("_r").alias("_r"))
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = F.last("_r", ignorenulls=True).over(before) if latest else F.max("_r").over(before)
        carry = (per.withColumn("_r", carried).filter(F.col("_r").isNotNull())
                 .withColumn("_o", F.col("_b") * F.lit(bucket)).withColumn("_side", F.lit(-1)).withColumn("_l", null_l))
        rows = rows.unionByName(carry)
    order = Window.partitionBy(*part).orderBy("_o", "_side", F.col("_r").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("_r", ignorenulls=True).over(upto) if latest else F.max("_r").over(upto)
    return rows.withColumn("_hit", hit).filter(F.col("_l").isNotNull()).select("_l.*", "_hit")


def asof_join(left: DataFrame, right: DataFrame, on, left_ts: str, right_ts: str, cols: list[str],
              tie: list[str] | None = None, strict: bool = False, forward: bool = False,
              bucket_days: int | None = None) -> DataFrame:
    """Left rows with ``cols`` of the nearest right row not after (``forward``: not before) ``left_ts``.

    ``strict`` excludes equal times; among right rows of one instant the greatest ``tie`` wins. ``bucket_days`` bounds a
    window partition to that many days of one key: set it whenever a key is not already bounded by a calendar.
    """
    keys = [on] if isinstance(on, str) else list(on)
    sign = -1 if forward else 1
    payload = F.struct(*[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie or [])],
                       *[F.col(c).alias(c) for c in cols], F.col(right_ts).alias("_right_ts"))
    out = _fill(left, right, keys, _instant(left_ts) * sign, _instant(right_ts) * sign, payload,
                right_first=not strict, latest=True, bucket=bucket_days and bucket_days * DAY_MICROS)
    return out.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols],
                      F.col("_hit._right_ts").alias("matched_ts"))


def asof_bitemporal(left: DataFrame, right: DataFrame, on, cutoff: str, as_of: str, available: str, retrieved: str,
                    cols: list[str], bucket_days: int | None = 32) -> DataFrame:
    """Latest fact (by as-of, available, retrieved) among those both available and retrieved by the cutoff."""
    keys = [on] if isinstance(on, str) else list(on)
    usable = right.filter(F.col(available).isNotNull() & F.col(retrieved).isNotNull())
    seen = F.greatest(_instant(available), _instant(retrieved))
    payload = F.struct(F.col(as_of).alias("_a"), F.col(available).alias("_v"), F.col(retrieved).alias("_g"),
                       *[F.col(c).alias(c) for c in cols])
    out = _fill(left, usable, keys, _instant(cutoff), seen, payload, True, latest=False,
                bucket=bucket_days and bucket_days * DAY_MICROS)
    return out.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols])


def nearest(left: DataFrame, right: DataFrame, on, left_ts: str, right_ts: str, cols: list[str], direction: str,
            limit_days: int, bucket_days: int | None = 32) -> DataFrame:
    """As-of join that refuses a match further than ``limit_days`` away; ``direction`` is ``after`` or ``before``."""
    out = asof_join(left, right, on, left_ts, right_ts, cols, forward=direction == "after", bucket_days=bucket_days)
    near = F.abs(F.datediff(F.col("matched_ts"), F.col(left_ts))) <= limit_days
    for c in cols + ["matched_ts"]:
        out = out.withColumn(f"_{c}", F.when(near, F.col(c)))
    return out.drop(*cols, "matched_ts").withColumnsRenamed({f"_{c}": c for c in cols + ["matched_ts"]})


def prior_bar(bars: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Each bar with its own ticker's previous traded session, found by ``lag`` rather than a correlated maximum."""
    w = Window.partitionBy(key).orderBy(ts)
    return (bars.withColumn("prior_close", F.lag("close").over(w)).withColumn("prior_date", F.lag(ts).over(w))
            .filter(F.col("prior_close").isNotNull()))


def with_benchmark(bars: DataFrame, bench: DataFrame, ts="session_date") -> DataFrame:
    """Equi-join on the session. The calendar is small, so the planner broadcasts it from its measured size."""
    return bars.join(bench, ts)


def calendar_ordinal(dates: DataFrame, ts="session_date", name="ordinal") -> DataFrame:
    """0-based position of every distinct date. Ranks are taken inside a year and shifted by the sizes of the years
    before, so no task ever sorts the whole calendar; only one row per year meets in a single window."""
    d = dates.select(ts).distinct().withColumn("_y", F.year(ts))
    years = d.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    years = years.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_y").orderBy(ts)) - 1
    return d.withColumn("_i", inside).join(years, "_y").select(ts, (F.col("_i") + F.col("_before")).alias(name))


def forward_targets(bars: DataFrame, calendar: DataFrame, steps: list[int], key="ticker", ts="session_date",
                    price="close") -> DataFrame:
    """Close at the benchmark calendar's n-th next session; NULL where the security did not trade that day."""
    pos = calendar_ordinal(calendar, ts)
    out = bars
    for n in steps:
        ahead = pos.select((F.col("ordinal") - n).alias("ordinal"), F.col(ts).alias(f"target_{n}"))
        goal = pos.join(ahead, "ordinal").select(ts, f"target_{n}")
        price_at = bars.select(key, F.col(ts).alias(f"target_{n}"), F.col(price).alias(f"close_t{n}"))
        out = out.join(goal, ts, "left").join(price_at, [key, f"target_{n}"], "left")
    return out


def reaction_session(events: DataFrame, hist: DataFrame, key="ticker", event_ts="event_date", ts="session_date",
                     cols: list[str] | None = None) -> DataFrame:
    """First session strictly after an announcement. An announcement on or before the first archived session, or after
    the last one, has no reaction inside the archive and is dropped."""
    cols = cols if cols is not None else [ts]
    dated = hist.withColumn("_first", F.min(ts).over(Window.partitionBy(key)))
    hit = asof_join(events.select(key, event_ts).distinct(), dated, key, event_ts, ts, [*cols, "_first"], strict=True, forward=True, bucket_days=None)
    return hit.filter(F.col(event_ts) > F.col("_first")).drop("_first").withColumnRenamed("matched_ts", "reaction_date")


def unexplained_jumps(bars: DataFrame, splits: DataFrame, threshold: float = 3.0, days: int = 3, key="ticker",
                      ts="session_date") -> DataFrame:
    """Close-to-close ratios at or above the threshold with no split within ``days``. Each split is expanded to its
    2 * days + 1 neighbouring dates, which turns the date tolerance into an equi anti-join."""
    w = Window.partitionBy(key).orderBy(ts)
    r = F.col("close") / F.lag("close").over(w)
    jumps = (bars.withColumn("_q", r).withColumn("jump_ratio", F.greatest("_q", 1 / F.col("_q"))).drop("_q")
             .filter(F.col("jump_ratio") >= threshold))
    near = splits.select(key, F.explode(F.sequence(F.date_sub("split_date", days), F.date_add("split_date", days))).alias(ts))
    return jumps.join(near.distinct(), [key, ts], "left_anti")


def follow_identity(obs: DataFrame, refs: DataFrame, ids: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Rows that carry a wanted stable id, or whose ticker is a verified alias of one; two equi-joins, not an OR join."""
    direct = obs.join(ids, "security_id", "left_semi").withColumn("identity", F.col("security_id"))
    alias = (refs.join(ids, "security_id", "left_semi").select(key, F.col("security_id").alias("identity")).distinct())
    by_alias = obs.join(alias, key)
    return direct.select(*obs.columns, "identity").unionByName(by_alias.select(*obs.columns, "identity")).distinct()


def ledger_members(snapshots: DataFrame, members: DataFrame, identities: DataFrame) -> DataFrame:
    return members.join(snapshots, "snapshot_id").join(identities, "identity_id")


def apply_supersedes(events: DataFrame, ident="accession", supersedes="supersedes") -> DataFrame:
    """Events that no other event replaces."""
    replaced = events.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(ident)).distinct()
    return events.join(replaced, ident, "left_anti")


def successor_path(members: DataFrame, terms: DataFrame) -> DataFrame:
    """Member with the security that took its place, one hop, and that security's own terms when it has any."""
    hop = terms.select("security_id", F.col("successor_id").alias("next_id"))
    second = terms.select(F.col("security_id").alias("next_id"), F.col("successor_id").alias("next_next_id"))
    return members.join(hop, "security_id", "left").join(second, "next_id", "left")


def holdings_change(holdings: DataFrame, manager="manager", cusip="cusip", period="period") -> DataFrame:
    """Position against the same manager's holding of the period directly before, with a change label."""
    prev = holdings.select(manager, cusip, (F.col(period) + 1).alias(period), F.col("shares").alias("prior_shares"))
    change = (F.col("shares") - F.col("prior_shares")) / F.col("prior_shares") * 100
    out = holdings.join(prev, [manager, cusip, period], "left")
    return out.withColumn("action", F.when(F.col("prior_shares").isNull() | (F.col("prior_shares") <= 0), "New")
                          .when(change >= 10, "Increased").when(change <= -10, "Reduced").otherwise("Held"))


def fx_convert(df: DataFrame, fx: DataFrame, fields: list[str], ts: str, currency="currency", home="USD") -> DataFrame:
    """Monetary fields in the home currency at the rate on or within 7 days before; without a rate they are NULL."""
    dated = nearest(df, fx, currency, ts, "rate_date", ["rate"], "before", 7)
    rate = F.when(F.col(currency) == home, F.lit(1.0)).otherwise(F.col("rate"))
    for f in fields:
        dated = dated.withColumn(f, F.col(f) * rate)
    return dated.drop("rate", "matched_ts")


def evidence_as_of(evidence: DataFrame, cutoffs: DataFrame, key: str, public_at="public_at", cutoff="cutoff") -> DataFrame:
    """Newest public evidence of an issuer at each cutoff."""
    cols = [c for c in evidence.columns if c not in (key, public_at)]
    return asof_join(cutoffs, evidence, key, cutoff, public_at, cols, tie=cols, bucket_days=32)


def reconcile(current: DataFrame, incoming: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Full outer comparison of two position lists."""
    c = current.select(key, F.col(value).alias("current_value"))
    i = incoming.select(key, F.col(value).alias("incoming_value"))
    gap = F.abs(F.col("current_value") - F.col("incoming_value"))
    return c.join(i, key, "full_outer").withColumn(
        "status", F.when(F.col("current_value").isNull(), "added").when(F.col("incoming_value").isNull(), "removed")
        .when(gap > tolerance, "changed").otherwise("unchanged"))


def except_keys(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")
