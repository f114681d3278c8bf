"""Append-only journals graded later against the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import verdict
from tidemark.operators import scores
from tidemark.operators.joins import asof_join
from tidemark.session import reliable_checkpoint

#: Asked securities up to which their list is sent to every task.
SENT_NAMES = 100_000


def alert_status(probability, base_rate, promoted: Column, clean: Column) -> Column:
    p, b = F.col(probability), F.col(base_rate)
    known = F.coalesce(p.isNotNull() & b.isNotNull() & clean, F.lit(False))
    doubled = p >= 2 * b
    return (F.when(~known, "abstain").when(promoted & (p >= policy.RESEARCH_ALERT_MIN) & doubled, "research_alert")
            .when((p >= policy.EARLY_WATCH_MIN) & doubled, "early_watch").otherwise("abstain"))


def _indexed(hist: DataFrame) -> DataFrame:
    """History rows with what grading needs at either end of a path: position and unclean rows so far."""
    w = Window.partitionBy("ticker").orderBy("session_date")
    return hist.select(
        "ticker", "session_date", "close", "bench_close", (F.row_number().over(w) - 1).alias("pos"),
        F.sum(F.when(F.col("clean"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("unclean"),
        F.when(F.col("clean"), 0).otherwise(1).alias("bad"))


def _range_minima(hist: DataFrame, longest: int) -> DataFrame:
    """Minima of the close and of the relative price over the next 1, 2, 4 ... rows, enough for ``longest`` rows. Each level
    is the smaller of two of the level before, so a path minimum is two lookups, not a range join."""
    w = Window.partitionBy("ticker").orderBy("session_date")
    out = hist.select("ticker", "session_date", F.col("close").alias("_l0"), (F.col("close") / F.col("bench_close")).alias("_r0"),
                      (F.row_number().over(w) - 1).alias("pos"))
    levels = max(longest, 1).bit_length()
    for k in range(1, levels):
        half = 2 ** (k - 1)
        out = out.withColumns({f"_{c}{k}": F.least(f"_{c}{k - 1}", F.lead(f"_{c}{k - 1}", half).over(w)) for c in "lr"})
    return out.select("ticker", "pos", *[F.array(*[f"_{c}{k}" for k in range(levels)]).alias(n) for c, n in (("l", "lows"), ("r", "rel_lows"))])


def _asked_history(asks: DataFrame, hist: DataFrame, names: int) -> DataFrame:
    """Histories of the securities asked for, stored once for the steps that read them. The others decide no outcome."""
    asked = asks.select("ticker").distinct()
    asked = F.broadcast(asked) if names <= SENT_NAMES else asked
    return reliable_checkpoint(hist.select("ticker", "session_date", "close", "bench_close", "clean").join(asked, "ticker", "left_semi"))


def outcome_calendar_days(journal: DataFrame, hist: DataFrame, symbol="symbol", decided="decision_date",
                          horizon="horizon_days", slip: int = policy.MAX_EXIT_SLIP_DAYS) -> DataFrame:
    """Grade each (symbol, decision date, horizon): enter the first session after the decision, leave the first session
    on or after decision + horizon (at most ``slip`` days late). Always a status, never a guess."""
    asks = journal.select(F.col(symbol).alias("ticker"), F.col(decided).alias("decided"), F.col(horizon).alias("horizon")).distinct()
    size = asks.agg(F.max("horizon").alias("longest"), F.count_distinct("ticker").alias("names")).first()
    asks = asks.withColumn("target", F.date_add("decided", F.col("horizon")))
    hist = _asked_history(asks, hist, size["names"])
    h = _indexed(hist)
    entry = h.select("ticker", "session_date", F.struct("session_date", "close", "bench_close", "pos", "unclean", "bad").alias("entry"))
    leave = h.select("ticker", "session_date", F.struct("session_date", "close", "bench_close", "pos", "unclean").alias("leave"))
    out = asof_join(asks, entry, "ticker", "decided", "session_date", ["entry"], strict=True, forward=True).drop("matched_ts")
    out = asof_join(out, leave, "ticker", "target", "session_date", ["leave"], forward=True).drop("matched_ts")
    last = hist.groupBy("ticker").agg(F.max("session_date").alias("last_session"))
    out = out.join(last, "ticker", "left")
    in_time = F.coalesce(F.col("leave.session_date") <= F.date_add("decided", F.col("horizon") + slip), F.lit(False))
    length = F.col("leave.pos") - F.col("entry.pos") + 1
    level = F.floor(F.log2(length.cast("double"))).cast("int")
    out = (out.withColumn("_k", F.when(in_time, level))
           .withColumn("_tail", F.when(in_time, F.col("leave.pos") - F.pow(F.lit(2.0), F.col("_k")).cast("bigint") + 1)))
    # A history has one row per day at most, so a path never holds more rows than its days.
    longest = (size["longest"] or 0) + slip + 1
    minima = _range_minima(hist, longest)
    heads = minima.select("ticker", F.col("pos").alias("_head"), F.col("lows").alias("_hl"), F.col("rel_lows").alias("_hr"))
    tails = minima.select("ticker", F.col("pos").cast("bigint").alias("_tail"), F.col("lows").alias("_tl"), F.col("rel_lows").alias("_tr"))
    out = out.withColumn("_head", F.when(in_time, F.col("entry.pos"))).join(heads, ["ticker", "_head"], "left").join(tails, ["ticker", "_tail"], "left")
    unclean = F.col("leave.unclean") - F.col("entry.unclean") + F.col("entry.bad")
    reason = (F.when(F.col("last_session").isNull(), "no archived sessions")
              .when(F.col("entry").isNull(), "entry not archived yet")
              .when(~in_time & (F.col("last_session") < F.col("target")), "exit not reached")
              .when(~in_time, "no session near exit").when(unclean > 0, "unresolved corporate action"))
    status = (F.when(reason.isin("entry not archived yet", "exit not reached"), "pending")
              .when(reason.isNotNull(), "unavailable").otherwise("matured"))
    done = F.col("status") == "matured"
    stock = (F.col("leave.close") / F.col("entry.close") - 1) * 100
    bench = (F.col("leave.bench_close") / F.col("entry.bench_close") - 1) * 100
    low = F.least(F.get("_hl", F.col("_k")), F.get("_tl", F.col("_k")))
    rel = F.least(F.get("_hr", F.col("_k")), F.get("_tr", F.col("_k")))
    out = out.withColumn("reason", reason).withColumn("status", status)
    return out.select(
        F.col("ticker").alias(symbol), F.col("decided").alias(decided), F.col("horizon").alias(horizon), "status", "reason",
        F.when(done, F.col("entry.session_date")).alias("entry_date"), F.when(done, F.col("leave.session_date")).alias("exit_date"),
        F.when(done, length - 1).alias("sessions_held"), F.when(done, stock).alias("stock_return"),
        F.when(done, bench).alias("benchmark_return"), F.when(done, stock - bench).alias("excess_return"),
        F.when(done, (low / F.col("entry.close") - 1) * 100).alias("max_drawdown"),
        F.when(done, (rel / (F.col("entry.close") / F.col("entry.bench_close")) - 1) * 100).alias("max_relative_drawdown"),
        F.when(done, verdict(stock - bench)).alias("verdict"))


def grade(journal: DataFrame, hist: DataFrame, horizon_sessions="horizon_sessions", threshold: float = 0.15,
          symbol="symbol", decided="decision_date") -> DataFrame:
    """Journal rows with their outcome; a session horizon is read as calendar days at 7/5."""
    rows = journal.withColumn("horizon_days", F.greatest(F.lit(1), F.rint(F.col(horizon_sessions) * 7 / 5).cast("int")))
    keys = [symbol, decided, "horizon_days"]
    out = rows.join(outcome_calendar_days(rows, hist, symbol, decided), keys, "left")
    excess = F.round("excess_return", 2)
    done = F.col("status") == "matured"
    return (out.withColumn("realised_swing", F.when(done, F.abs(excess / 100) >= threshold))
            .withColumn("realised_direction", F.when(done, F.when(excess > 0, "up").otherwise("down"))))


def signal_calibration(signals: DataFrame, hist: DataFrame, horizons: list[int], bullish: list[str], graded: list[str]) -> DataFrame:
    """Per horizon: matured, pending and ungradeable counts, hit rates without neutral results, average excess, drawdown."""
    rows = (signals.filter(F.col("action").isin(graded))
            .withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    out = rows.join(outcome_calendar_days(rows, hist), ["symbol", "decision_date", "horizon_days"])
    bull, done = F.col("action").isin(bullish), F.col("status") == "matured"
    excess = F.round("excess_return", 2)
    right = F.when(done & (F.col("verdict") != "neutral"), F.when(bull, excess > 0).otherwise(excess < 0).cast("double"))
    return out.groupBy("horizon_days").agg(
        F.count_if(done).alias("matured"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "unavailable").alias("ungradeable"), (F.avg(right) * 100).alias("hit_rate"),
        (F.avg(F.when(F.col("confidence") == "High", right)) * 100).alias("high_confidence_hit_rate"),
        F.count_if(F.col("verdict") == "neutral").alias("neutral"), F.avg(excess).alias("avg_excess"),
        F.avg(F.when(bull, F.round("max_drawdown", 2))).alias("avg_buy_drawdown"))


def manager_calibration(ideas: DataFrame, hist: DataFrame, snapshots: DataFrame | None = None,
                        horizons: tuple[int, ...] = (90, 180, 365), minimum: int = 10) -> DataFrame:
    """Per manager: ideas recorded, matured outcomes by horizon, hit rate and average excess of the longest horizon.

    ``snapshots`` (symbol, date, price, benchmark_price) grades what the archive cannot; such results are counted as
    provisional and never validate anyone.
    """
    rows = (ideas.filter(F.col("action").isin("New", "Increased"))
            .withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    out = rows.join(outcome_calendar_days(rows, hist), ["symbol", "decision_date", "horizon_days"])
    long = F.col("horizon_days") == max(horizons)
    done = F.col("status") == "matured"
    provisional = F.lit(False)
    if snapshots is not None:
        open_rows = out.filter(~done).select("symbol", "decision_date", "horizon_days").distinct()
        start = asof_join(open_rows, snapshots, "symbol", "decision_date", "date", ["price", "benchmark_price"], forward=True, bucket_days=32)
        start = (start.filter("price > 0 AND benchmark_price > 0").withColumn("_first", F.col("matched_ts"))
                 .withColumn("_goal", F.date_add("matched_ts", F.col("horizon_days"))).select("symbol", "decision_date", "horizon_days", "_goal"))
        end = asof_join(start, snapshots, "symbol", "_goal", "date", ["price", "benchmark_price"], forward=True, bucket_days=32)
        good = (F.col("matched_ts") <= F.date_add("_goal", 30)) & (F.col("price") > 0) & (F.col("benchmark_price") > 0)
        out = out.join(end.filter(good).select("symbol", "decision_date", "horizon_days", F.lit(True).alias("_prov")),
                       ["symbol", "decision_date", "horizon_days"], "left")
        provisional = F.coalesce(F.col("_prov"), F.lit(False))
    excess = F.round("excess_return", 2)
    per = out.groupBy("manager").agg(
        F.count_if(long).alias("ideas"),
        *[F.count_if(done & (F.col("horizon_days") == h)).alias(f"matured_{h}") for h in horizons],
        F.count_if(long & ~done & provisional).alias("provisional"),
        F.avg(F.when(done & long, excess)).alias("avg_excess"),
        (F.avg(F.when(done & long & (F.col("verdict") != "neutral"), (excess > 0).cast("double"))) * 100).alias("hit_rate"))
    return per.withColumn("validated", F.col(f"matured_{max(horizons)}") >= minimum)


def promotion_metrics(graded: DataFrame, critical_incident: bool | None = None, risk_review_accepted: bool = False) -> DataFrame:
    """Everything the promotion gates read, then the gates. ``graded`` comes from ``grade`` plus alert status and p, and is stored
    once for all of them."""
    graded = reliable_checkpoint(graded.select("decision_date", "status", "p", "direction", "realised_swing", "realised_direction", "alert_status"))
    done = graded.filter("status = 'matured'").withColumn("label", F.col("realised_swing").cast("int")).withColumn("_j", F.lit(1))
    watch = F.col("alert_status").isin("early_watch", "research_alert")
    head = graded.agg(F.count_distinct("decision_date").alias("sessions"), F.count_if(F.col("status") == "matured").alias("matured"),
                      F.count_if(F.col("status") == "pending").alias("awaiting"), F.lit(1).alias("_j"))
    body = done.agg(F.count_if(watch).alias("watches"), F.sum("label").alias("swings"),
                    F.avg("label").alias("base_rate"), F.avg(F.when(watch, F.col("label"))).alias("alert_precision"),
                    F.avg(F.when(F.col("direction").isNotNull(), (F.col("direction") == F.col("realised_direction")).cast("double"))).alias("directional_accuracy"),
                    F.lit(1).alias("_j"))
    skill = scores.score(done).select("brier_skill", F.lit(1).alias("_j"))
    gap = scores.ece(scores.reliability(done)).select(F.col("ece").alias("calibration_error"), F.lit(1).alias("_j"))
    ci = scores.cluster_bootstrap(done, "decision_date", F.when(watch, F.col("label")).otherwise(0), F.when(watch, 1).otherwise(0))
    out = head
    for part in (body, skill, gap, ci.select(F.col("lower95").alias("precision_lower95"), F.lit(1).alias("_j"))):
        out = out.join(part, "_j", "left")
    out = (out.withColumn("critical_incident", F.lit(critical_incident).cast("boolean"))
           .withColumn("risk_review_accepted", F.lit(risk_review_accepted)))
    return scores.promotion_gates(out.drop("_j"))


def journal_summary(journal: DataFrame, model="model_id", session="decision_date") -> DataFrame:
    return journal.agg(F.count_distinct(model).alias("models"), F.count(F.lit(1)).alias("predictions"),
                       F.count_distinct(session).alias("sessions"), F.min(session).alias("first_session"),
                       F.max(session).alias("last_session"))


def current_models(entries: DataFrame, model="model_id", order="sequence") -> DataFrame:
    """Latest registry entry of each model."""
    rest = [c for c in entries.columns if c not in (model,)]
    return entries.groupBy(model).agg(F.max_by(F.struct(*rest), order).alias("_l"), F.count(F.lit(1)).alias("versions")).select(model, "versions", "_l.*")
