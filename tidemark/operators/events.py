"""Issuer events: point-in-time features, announcement reactions, cadence and insider activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import session_cutoff, signed_log10
from tidemark.operators.joins import reaction_session
from tidemark.operators.quantiles import exact_median
from tidemark.session import reliable_checkpoint
from tidemark.operators.scores import cluster_bootstrap

_MONEY = "decimal(38,6)"


def event_features(hist: DataFrame, events: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Filing features of every session, from events that were readable at its cutoff.

    No event is matched with the sessions it covers. Each event becomes dated changes instead: it enters on the first day
    whose cutoff it was readable at and, for windowed sums, leaves when its own date falls out of the window. Changes are
    summed per (security, day), so a busy issuer costs at most one row per day, and one running window over days and
    sessions gives all features. Sums are decimal, so entering and leaving cancel exactly.
    """
    readable = F.greatest("published_at", "available_at")
    day = F.to_date(readable)
    seen = F.when(readable <= session_cutoff(day), day).otherwise(F.date_add(day, 1))
    ev = events.filter(F.col("published_at").isNotNull() & F.col("available_at").isNotNull()).withColumn("_seen", seen)
    ev = ev.withColumn("_in", F.greatest("_seen", "event_date"))
    value = F.coalesce(F.col("value"), F.lit(0.0)).cast(_MONEY)
    signed = (F.when(F.col("event_type") == "insider_buy", value).when(F.col("event_type") == "insider_sell", -value)
              .otherwise(F.lit(0).cast(_MONEY)))
    filing = (F.col("event_type") == "filing_event").cast("int")

    def dated(when: Column, visible=0, net=None, material=None, live=False) -> Column:
        on = F.col("event_date")
        return F.struct(
            when.alias("day"), F.lit(visible).alias("visible"), (net if net is not None else F.lit(0).cast(_MONEY)).cast(_MONEY).alias("net"),
            (material if material is not None else F.lit(0)).alias("material"),
            (F.when(F.col("event_type") == "results", on) if live else F.lit(None).cast("date")).alias("results"),
            (F.when(F.col("event_type") == "insider_buy", on) if live else F.lit(None).cast("date")).alias("bought"))

    def leave(days):
        return F.date_add("event_date", days + 1)
    changes = F.array_compact(F.array(
        dated(F.col("_seen"), visible=1), dated(F.col("_in"), live=True),
        F.when((signed != 0) & (F.col("_in") < leave(90)), dated(F.col("_in"), net=signed)),
        F.when((signed != 0) & (F.col("_in") < leave(90)), dated(leave(90), net=-signed)),
        F.when((filing == 1) & (F.col("_in") < leave(30)), dated(F.col("_in"), material=filing)),
        F.when((filing == 1) & (F.col("_in") < leave(30)), dated(leave(30), material=-filing))))
    daily = (ev.select(key, F.explode(changes).alias("c")).select(key, "c.*").groupBy(key, "day").agg(
        F.sum("visible").alias("visible"), F.sum("net").cast(_MONEY).alias("net"), F.sum("material").alias("material"),
        F.max("results").alias("results"), F.max("bought").alias("bought")))
    rows = daily.withColumn("_side", F.lit(0)).unionByName(
        hist.select(key, F.col(ts).alias("day"), F.lit(1).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)

    def since(col):
        return F.least(F.datediff("day", F.max(col).over(w)), F.lit(policy.MAX_DAYS_SINCE_EVENT)).cast("double")
    net = F.coalesce(F.sum("net").over(w).cast("double"), F.lit(0.0))
    out = (rows.withColumn("_d1", since("results")).withColumn("_d2", since("bought")).withColumn("_net", net)
           .withColumn("_mat", F.coalesce(F.sum("material").over(w), F.lit(0))).withColumn("_vis", F.coalesce(F.sum("visible").over(w), F.lit(0)))
           .filter("_side = 1"))
    return out.select(key, F.col("day").alias(ts), F.col("_d1").alias("days_since_results"), F.col("_d2").alias("days_since_insider_buy"),
                      F.when(F.col("_net") == 0, 0.0).otherwise(signed_log10("_net")).alias("insider_net_value_90d"),
                      F.col("_mat").cast("double").alias("material_filings_30d"), F.col("_vis").alias("events_visible"))


# --- announcement reactions ------------------------------------------------------------------------------------------

def announcement_windows(hist: DataFrame, announcements: DataFrame, entries=policy.ENTRY_OFFSETS, exits=policy.EXIT_OFFSETS,
                         key="ticker", ts="session_date") -> DataFrame:
    """Excess return in percent of every (announcement, entry, exit). Prices around each session are read by ``lead`` and
    ``lag`` in one window pass and travel with the session to its announcements, so all steps share the ticker's partitioning."""
    w = Window.partitionBy(key).orderBy(ts)
    offsets = sorted(set(entries) | set(exits))

    def at(col, o):
        return F.lead(col, o).over(w) if o >= 0 else F.lag(col, -o).over(w)
    around = hist.select(key, ts, *[F.struct(at("close", o).alias("c"), at("bench_close", o).alias("b")).alias(f"o{o}") for o in offsets])
    hit = reaction_session(announcements, around, key, ts=ts, cols=[f"o{o}" for o in offsets])
    pairs = []
    for e in entries:
        for x in exits:
            if x > e:
                stock = F.col(f"o{x}.c") / F.col(f"o{e}.c") - 1
                bench = F.col(f"o{x}.b") / F.col(f"o{e}.b") - 1
                pairs.append(F.struct(F.lit(len(pairs)).alias("combo"), F.lit(e).alias("entry_offset"), F.lit(x).alias("exit_offset"),
                                      ((stock - bench) * 100).alias("excess")))
    return (hit.select(key, "event_date", "reaction_date", F.explode(F.array(*pairs)).alias("p"))
            .select(key, "event_date", "reaction_date", "p.*").filter("excess IS NOT NULL"))


def event_window_stats(windows: DataFrame, minimum: int = policy.MIN_EVENTS, cost: float = policy.ROUND_TRIP_COST_PERCENT) -> DataFrame:
    """One row per (entry, exit): size, centre, spread, win rate, cost check and a date-clustered interval."""
    by = ["entry_offset", "exit_offset"]
    windows = reliable_checkpoint(windows.select(*by, "reaction_date", "excess"))  # read by the aggregate, the median and the bootstrap
    out = windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.avg("excess").alias("mean_excess"), F.stddev_pop("excess").alias("spread"),
        F.avg((F.col("excess") > 0).cast("double")).alias("win_rate"), F.min("excess").alias("worst"), F.max("excess").alias("best"))
    out = out.join(exact_median(windows, by, "excess", "median_excess"), by)
    ci = cluster_bootstrap(windows, "reaction_date", F.col("excess"), F.lit(1), by=by)
    out = out.join(ci.select(*by, "lower95", "upper95"), by, "left")
    enough = F.col("events") >= minimum
    for c in ("mean_excess", "spread", "win_rate", "worst", "best", "median_excess", "lower95", "upper95"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    return (out.withColumn("sufficient", enough).withColumn("net_of_costs", F.col("mean_excess") - cost)
            .withColumn("beats_costs", F.coalesce(F.col("lower95") > cost, F.lit(False))))


def event_study(windows: DataFrame) -> DataFrame:
    """Counts of the whole study: announcements, securities, windows tested and windows that survive costs."""
    windows = reliable_checkpoint(windows)
    stats = event_window_stats(windows)
    one = F.lit(1).alias("_j")
    events = windows.select("ticker", "event_date").distinct().agg(F.count(F.lit(1)).alias("announcements"), F.count_distinct("ticker").alias("securities"), one)
    tested = stats.agg(F.count_if("sufficient").alias("windows_tested"), F.count_if("beats_costs").alias("surviving_windows"), one)
    return events.join(tested, "_j").drop("_j")


def persistence(windows: DataFrame, minimum: int = 4, key="ticker") -> DataFrame:
    """Does a security's best early window keep working late? One row: carried mean, all-window mean, advantage with its
    interval, beat rate and verdict."""
    order = Window.partitionBy(key).orderBy("reaction_date", "event_date")
    # Announcements are numbered where their windows lie: all rows of one share a rank, and the greatest rank is their count.
    ev = windows.withColumn("_rn", F.dense_rank().over(order))
    rows = (ev.withColumn("_n", F.max("_rn").over(Window.partitionBy(key))).withColumn("_half", F.floor(F.col("_n") / 2))
            .filter((F.col("_half") >= minimum) & (F.col("_n") - F.col("_half") >= minimum))
            .withColumn("late", F.col("_rn") > F.col("_half")))
    means = rows.groupBy(key, "combo").agg(F.avg(F.when(~F.col("late"), F.col("excess"))).alias("early"), F.avg(F.when(F.col("late"), F.col("excess"))).alias("late"))
    best = F.max_by(F.col("late"), F.when(F.col("early").isNotNull(), F.struct(F.col("early"), -F.col("combo"))))
    per = (means.groupBy(key).agg(best.alias("carried"), F.avg("late").alias("average"), F.count("early").alias("_e"))
           .filter("_e > 0 AND carried IS NOT NULL AND average IS NOT NULL").withColumn("diff", F.col("carried") - F.col("average")))
    per = reliable_checkpoint(per)  # one row per security, read by the bootstrap and the summary
    ci = cluster_bootstrap(per, key, F.col("diff"), F.lit(1)).select("lower95", "upper95", F.lit(1).alias("_j"))
    out = per.agg(F.count(F.lit(1)).alias("securities"), F.avg("carried").alias("carried_mean"), F.avg("average").alias("all_window_mean"),
                  F.avg("diff").alias("advantage"), F.avg((F.col("diff") > 0).cast("double")).alias("beat_rate"), F.lit(1).alias("_j"))
    error = F.sqrt(F.lit(0.25) / F.col("securities"))
    return (out.join(ci, "_j", "left").drop("_j").withColumn(
        "convincing", F.coalesce((F.col("lower95") > 0) & (F.col("beat_rate") - 0.5 > 2 * error), F.lit(False))))


def move_timing(hist: DataFrame, announcements: DataFrame, steps: int = 5, minimum: int = 3, key="ticker", ts="session_date") -> DataFrame:
    """Where in the week after an announcement the movement lands, per security."""
    from tidemark.operators.frames import session_moves
    w = Window.partitionBy(key).orderBy(ts)
    m = session_moves(hist, key, ts).withColumn("_a", F.abs("session_move"))
    m = m.select(key, F.col(ts).alias("reaction_date"), F.array(*[F.lead("_a", s).over(w) if s else F.col("_a") for s in range(steps)]).alias("moves"))
    hit = reaction_session(announcements, hist, key).join(m, [key, "reaction_date"])
    hit = hit.filter(~F.array_contains(F.transform("moves", lambda x: x.isNull()), True))
    rest = F.aggregate(F.slice("moves", 2, steps - 1), F.lit(0.0), lambda a, x: a + x)
    per = hit.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.avg(F.get("moves", F.lit(0))).alias("reaction_move"), F.avg(rest).alias("rest"))
    total = F.col("reaction_move") + F.col("rest")
    return (per.filter((F.col("events") >= minimum) & (total != 0)).withColumn("other_day_move", F.col("rest") / (steps - 1))
            .withColumn("reaction_share", F.col("reaction_move") / total)
            .withColumn("times_ordinary", F.col("reaction_move") / F.nullif(F.col("other_day_move"), F.lit(0.0))).drop("rest"))


def reaction_sizes(moves: DataFrame, reaction_dates: DataFrame, key="ticker", ts="session_date") -> DataFrame:
    """Size of reactions against ordinary days, per security; days per security are bounded by the calendar."""
    mark = reaction_dates.select(key, F.col("reaction_date").alias(ts)).distinct().withColumn("_hit", F.lit(True))
    m = moves.filter("session_move IS NOT NULL").join(mark, [key, ts], "left")
    size = F.when(F.col("_hit"), F.abs(F.round("session_move", 2)))
    ordinary = F.when(F.col("_hit").isNull(), F.abs("session_move"))
    out = m.groupBy(key).agg(F.count("_hit").alias("events"), F.percentile(size, F.lit(0.5)).alias("typical"), F.min(size).alias("smallest"),
                             F.max(size).alias("largest"), F.percentile(ordinary, F.lit(0.5)).alias("ordinary"))
    return out.filter("events > 0").withColumn("multiple", F.col("typical") / F.nullif(F.col("ordinary"), F.lit(0.0)))


# --- announcement cadence --------------------------------------------------------------------------------------------

def _median_of(a: Column) -> Column:
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0


def announcement_cadence(announcements: DataFrame, today: Column, key="ticker", ts="event_date", band=(70, 110), min_dates: int = 4,
                         min_gaps: int = 3, max_spread: int = 28) -> DataFrame:
    """Expected next announcement with a window as wide as the past spread; quartiles are medians of halves.

    Only gaps inside the quarterly band are gathered, which bounds the list by the years of history.
    """
    w = Window.partitionBy(key).orderBy(ts)
    d = announcements.select(key, ts).distinct().withColumn("_gap", F.datediff(ts, F.lag(ts).over(w)))
    keep = F.when(F.col("_gap").between(*band), F.col("_gap"))
    per = d.groupBy(key).agg(F.count(F.lit(1)).alias("dates"), F.max(ts).alias("last_confirmed"), F.sort_array(F.collect_list(keep)).alias("_g"))
    n = F.size("_g")
    half = F.floor(n / 2).cast("int")
    spread = F.floor(_median_of(F.slice("_g", F.when(n % 2 == 1, half + 2).otherwise(half + 1), half)) - _median_of(F.slice("_g", 1, half))).cast("int")
    per = per.withColumn("gaps", n).withColumn("spread", F.when(n >= min_gaps, spread)).withColumn("typical_gap", F.when(n >= min_gaps, F.floor(_median_of(F.col("_g"))).cast("int")))
    status = (F.when(F.col("dates") < min_dates, "insufficient-history").when(F.col("gaps") < min_gaps, "irregular-cadence")
              .when(F.col("spread") > max_spread, "irregular-cadence").otherwise("projected"))
    per = per.withColumn("status", status)
    ok = F.col("status") == "projected"
    per = (per.withColumn("expected_date", F.when(ok, F.date_add("last_confirmed", F.col("typical_gap"))))
           .withColumn("half_width", F.when(ok, F.least(F.lit(14), F.greatest(F.lit(4), F.rint(F.col("spread") / 2).cast("int") + 2)))))
    per = (per.withColumn("window_start", F.date_sub("expected_date", F.col("half_width")))
           .withColumn("window_end", F.date_add("expected_date", F.col("half_width")))
           .withColumn("days_away", F.datediff("expected_date", today))
           .withColumn("window_open", today.between(F.col("window_start"), F.col("window_end"))).withColumn("overdue", today > F.col("window_end")))
    flag = (F.when(~ok, "unknown").when(F.col("overdue"), "overdue").when(F.col("window_open"), "window-open")
            .when(F.col("days_away").between(0, 14), "approaching").otherwise("clear"))
    precision = F.when(F.col("half_width") <= 5, "firm").when(F.col("half_width") <= 9, "approximate").when(ok, "wide")
    return per.withColumn("flag", flag).withColumn("precision", precision).drop("_g")


def earnings_radar(cadence: DataFrame, horizon_days: int = 14) -> DataFrame:
    """Announcements due within the horizon or with an open window; securities without a projection are listed too."""
    due = ~F.col("overdue") & (F.col("window_open") | F.col("days_away").between(0, horizon_days))
    return (cadence.withColumn("kind", F.when(F.col("status") != "projected", "unresolved").when(due, "upcoming"))
            .filter(F.col("kind").isNotNull()))


def results_due_this_week() -> Column:
    """Whether a cadence row puts results inside the coming week."""
    return F.coalesce(F.col("days_away").between(0, 7) | (F.col("window_open") & ~F.col("overdue")), F.lit(False))


# --- insiders --------------------------------------------------------------------------------------------------------

# Transaction codes of the ownership form.
OPEN_MARKET_BUY, OPEN_MARKET_SELL = "P", "S"
ROUTINE_CODES = {"A": "Grant or award", "M": "Option or derivative exercise", "F": "Shares surrendered to cover tax", "G": "Gift",
                 "C": "Conversion of a derivative", "D": "Disposition to the issuer", "I": "Discretionary transaction"}


def insider_summary(tx: DataFrame, as_of: Column, windows=(30, 90, 180), key="ticker") -> DataFrame:
    """Open-market buys and sells per window, one row per security. Rows collapse per (security, owner) first, so distinct
    buyers are counted without a distinct over transactions."""
    known = tx.filter(F.col("filed_on") <= as_of)
    routine = F.col("code").isin(*ROUTINE_CODES)
    buy, sell = F.col("code") == OPEN_MARKET_BUY, F.col("code") == OPEN_MARKET_SELL
    value = F.coalesce("value", F.lit(0.0))
    aggs = [F.max(F.when(buy, F.col("filed_on"))).alias("_last"), F.count_if(routine).alias("routine")]
    for d in windows:
        live = F.col("filed_on") >= F.date_sub(as_of, d)
        aggs += [F.count_if(buy & live).alias(f"buys_{d}"), F.count_if(sell & live).alias(f"sells_{d}"),
                 F.count_if(sell & live & ~F.coalesce(F.col("planned"), F.lit(False))).alias(f"unplanned_sells_{d}"),
                 F.sum(F.when(buy & live, value).otherwise(0.0)).alias(f"buy_value_{d}"), F.sum(F.when(sell & live, value).otherwise(0.0)).alias(f"sell_value_{d}")]
    per_owner = known.groupBy(key, "owner").agg(*aggs)
    out = [F.max("_last").alias("last_buy"), F.sum("routine").alias("routine")]
    for d in windows:
        out += [F.sum(f"{c}_{d}").alias(f"{c}_{d}") for c in ("buys", "sells", "unplanned_sells", "buy_value", "sell_value")]
        out.append(F.count_if((F.col("_last") >= F.date_sub(as_of, d)) & F.col("owner").isNotNull()).alias(f"buyers_{d}"))
    res = per_owner.groupBy(key).agg(*out).withColumn("days_since_buy", F.datediff(as_of, "last_buy"))
    for d in windows:
        res = res.withColumn(f"net_value_{d}", F.col(f"buy_value_{d}") - F.col(f"sell_value_{d}"))
    return res


def issuer_event_rows(tx: DataFrame, filings: DataFrame) -> DataFrame:
    """Ownership transactions and filing items as one event table; routine and unknown codes are left out."""
    trades = tx.filter(F.col("code").isin(OPEN_MARKET_BUY, OPEN_MARKET_SELL)).select(
        "ticker", F.when(F.col("code") == OPEN_MARKET_BUY, "insider_buy").otherwise("insider_sell").alias("event_type"),
        F.col("transaction_date").alias("event_date"), "published_at", "available_at", "value", F.col("owner").alias("detail"), "accession")
    items = filings.select("ticker", F.when(F.col("item") == "2.02", "results").otherwise("filing_event").alias("event_type"),
                           F.col("filed_on").alias("event_date"), "published_at", "available_at", F.lit(None).cast("double").alias("value"),
                           F.col("item").alias("detail"), "accession")
    return trades.unionByName(items).dropDuplicates(["ticker", "event_type", "accession", "event_date", "detail"])
