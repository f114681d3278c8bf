"""Row-level screens with explicit reasons. Unknown is a result of its own: a NULL is never treated as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import finite, is_hash, utc_clean, currency_clean, visible

REQUIRED = ("active", "close", "corporate_actions_clean", "currency", "exchange_mic", "identity_clean", "market_cap",
            "median_dollar_volume_20d", "prior_sessions", "security_type")
NUMBERS = ("close", "market_cap", "median_dollar_volume_20d", "prior_sessions")


def _reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in pairs]))


def _not_true(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def investability(df: DataFrame, min_price=policy.MIN_PRICE, min_cap=policy.MIN_MARKET_CAP,
                  min_volume=policy.MIN_MEDIAN_DOLLAR_VOLUME, min_sessions=policy.MIN_PRIOR_SESSIONS) -> DataFrame:
    """Three-valued eligibility: any missing or non-finite input is ``unknown``, else every failed rule is listed."""
    missing = _reasons([(F.col(c).isNull(), f"missing {c}") for c in REQUIRED])
    invalid = _reasons([(finite(c).isNull(), f"invalid {c}") for c in NUMBERS])
    failed = _reasons([
        (~F.upper("exchange_mic").isin(*policy.INVESTABLE_EXCHANGES), "venue"),
        (~F.lower("security_type").isin(*policy.INVESTABLE_TYPES), "type"),
        (_not_true("active"), "inactive"), (_not_true("identity_clean"), "identity"),
        (_not_true("corporate_actions_clean"), "corporate actions"), (F.upper("currency") != "USD", "currency"),
        (F.col("close") < min_price, "price"), (F.col("market_cap") < min_cap, "market value"),
        (F.col("median_dollar_volume_20d") < min_volume, "dollar volume"),
        (F.col("prior_sessions") < min_sessions, "history")])
    return (df.withColumn("reasons", F.when(F.size(missing) > 0, missing).when(F.size(invalid) > 0, invalid)
                          .otherwise(failed))
            .withColumn("eligibility", F.when((F.size(missing) > 0) | (F.size(invalid) > 0), "unknown")
                        .when(F.size("reasons") == 0, "eligible").otherwise("ineligible")))


def research_eligible(df: DataFrame, min_price=policy.MIN_PRICE, min_volume=policy.MIN_MEDIAN_DOLLAR_VOLUME,
                      min_sessions=policy.MIN_PRIOR_SESSIONS, volume="dollar_volume") -> DataFrame:
    """The weaker research screen: price, liquidity, history and clean actions; market value is not applied."""
    reasons = _reasons([
        (F.col("close") < min_price, "price"), (F.col(volume).isNull(), "dollar volume missing"),
        (F.col(volume) < min_volume, "dollar volume"), (F.col("idx") < min_sessions, "history"),
        (_not_true("clean"), "corporate actions")])
    return df.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def visible_at(df: DataFrame, cutoff: str, published="published_at", available="available_at") -> DataFrame:
    return df.filter(visible(published, available, cutoff))


def bad_bars(bars: DataFrame) -> DataFrame:
    """Bars that fail price integrity."""
    bad = (F.col("close").isNull() | (F.col("close") <= 0) | (F.col("high") < F.col("low")) | (F.col("volume") < 0)
           | _not_true("adjusted"))
    return bars.filter(F.coalesce(bad, F.lit(True)))


def clean_text_fields(df: DataFrame, currency: str, digest: str, instant: str) -> DataFrame:
    return (df.withColumn("currency_clean", currency_clean(currency)).withColumn("is_hash", is_hash(digest))
            .withColumn("utc_clean", utc_clean(instant)))


def clean_positions(df: DataFrame, allowed: DataFrame, symbol="symbol", quantity="quantity") -> DataFrame:
    """Upper-cased, rounded, non-negative positions; symbols outside the allowed list are marked, not dropped."""
    tidy = (df.withColumn(symbol, F.upper(F.trim(symbol))).withColumn(quantity, F.round(finite(quantity), 6))
            .filter((F.col(quantity) >= 0) & (F.col(symbol) != "")))
    mark = allowed.select(F.col(symbol)).distinct().withColumn("_ok", F.lit(True))
    return tidy.join(mark, symbol, "left").withColumn("supported", F.col("_ok").isNotNull()).drop("_ok")


def validate_list(df: DataFrame, group: str, probability="p", passed="passed", total="total") -> DataFrame:
    """One row per list: the whole list is invalid when any probability is missing or outside [0, 1], or when more
    checks passed than exist."""
    p = finite(probability)
    good = F.coalesce((p >= 0) & (p <= 1), F.lit(False)) & F.coalesce(F.col(passed) <= F.col(total), F.lit(False))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("entries"), F.bool_and(good).alias("valid"))


def valid_cases(timeline: DataFrame, case: str, stages: list[str], stage="stage", at="published_at",
                verified="verified", url="url", declared="declared_stage") -> DataFrame:
    """One row per case: stages never regress, the last verified stage is the declared one, every item has a source."""
    pos = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    w = Window.partitionBy(case).orderBy(at, "item")
    rows = timeline.withColumn("_pos", pos).withColumn("_prev", F.lag("_pos").over(w))
    ok = (F.col("_pos") > 0) & F.coalesce(F.col("_pos") >= F.col("_prev"), F.lit(True))
    sourced = F.coalesce(F.col(url).startswith("https://"), F.lit(False))
    per = rows.groupBy(case).agg(
        F.count(F.lit(1)).alias("items"), F.bool_and(ok).alias("monotone"), F.bool_and(sourced).alias("sourced"),
        F.max_by(F.when(F.col(verified), F.col(stage)), F.when(F.col(verified), F.struct(at, "item"))).alias("last_verified"),
        F.max(declared).alias("declared"))
    return per.withColumn("valid", F.col("monotone") & F.col("sourced")
                          & F.coalesce(F.col("last_verified") == F.col("declared"), F.lit(False)))


def clock_violations(df: DataFrame, published="published_at", available="available_at", retrieved="retrieved_at",
                     recorded="recorded_at", as_of="as_of") -> DataFrame:
    """Rows whose clocks run backwards, with the broken pairs."""
    def out_of_order(a, b):
        return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) > F.col(b))
    v = _reasons([(out_of_order(published, available), "published after available"),
                  (out_of_order(available, retrieved), "available after retrieved"),
                  (out_of_order(retrieved, recorded), "retrieved after recorded"),
                  (F.to_date(as_of) > F.to_date(published), "as-of after published")])
    return df.withColumn("violations", v).filter(F.size("violations") > 0)


def admissible_evidence(df: DataFrame, cutoff: str, available="available_at", tier="source_tier") -> DataFrame:
    """Evidence with a verdict: dated after the cutoff or of an unknown source tier it is refused, and says why."""
    why = (F.when(F.col(available).isNull(), "undated").when(F.col(available) > F.col(cutoff), "after cutoff")
           .when(~F.coalesce(F.col(tier).between(1, 4), F.lit(False)), "source tier"))
    return df.withColumn("refusal", why).withColumn("admissible", F.col("refusal").isNull())
