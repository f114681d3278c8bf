"""Disclosed holdings of investment managers: consolidation, changes, shared ideas, companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import company_key
from tidemark.operators.joins import holdings_change

ACTIVE = ("New", "Increased")
# Strength of an action when one manager holds several share classes.
ACTION_STRENGTH = {"New": 4, "Increased": 3, "Held": 2, "Reduced": 1}


def consolidate(holdings: DataFrame, keys: tuple[str, ...] = ("manager", "period", "cusip"), names: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """One row per security and filing; descriptive fields come from any of its rows (they agree)."""
    return holdings.groupBy(*keys).agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"), *[F.min(n).alias(n) for n in names])


def manager_positions(holdings: DataFrame) -> DataFrame:
    """Each manager's newest filing against the one before: action and portfolio weight."""
    newest = holdings.groupBy("manager").agg(F.max("period").alias("period"))
    changed = holdings_change(holdings).join(newest, ["manager", "period"])
    total = changed.groupBy("manager").agg(F.sum("value").alias("_total"))
    return changed.join(total, "manager").withColumn("weight", F.col("value") / F.nullif(F.col("_total"), F.lit(0.0)) * 100).drop("_total")


def manager_ideas(positions: DataFrame) -> DataFrame:
    """One row per security: owners, active buyers, highest weight."""
    return positions.groupBy("cusip").agg(F.min("issuer").alias("issuer"), F.count(F.lit(1)).alias("owners"), F.count_if(F.col("action").isin(*ACTIVE)).alias("active_buyers"),
                                          F.max("weight").alias("highest_conviction"))


def ranked_managers(positions: DataFrame) -> DataFrame:
    """Managers of each security, active buyers first and then by weight, as rows with a rank rather than as a list."""
    w = Window.partitionBy("cusip").orderBy(F.when(F.col("action").isin(*ACTIVE), 0).otherwise(1), F.desc("weight"), "manager")
    return positions.withColumn("rank", F.row_number().over(w))


def idea_order() -> list:
    return [F.desc("active_buyers"), F.desc("owners"), F.desc("highest_conviction"), F.asc("issuer")]


def dedupe_companies(positions: DataFrame) -> DataFrame:
    """Share classes of one issuer merged: a manager's weights add up, the strongest action counts, and the class with the
    most owners (then active buyers, then conviction) stands for the company."""
    strength = F.create_map(*[F.lit(x) for kv in ACTION_STRENGTH.items() for x in kv])
    p = positions.withColumn("company", company_key("issuer", F.col("cusip")))
    per_manager = p.groupBy("company", "manager").agg(F.sum("weight").alias("weight"), F.max_by("action", F.try_element_at(strength, F.col("action"))).alias("action"))
    merged = per_manager.groupBy("company").agg(F.count(F.lit(1)).alias("owners"), F.count_if(F.col("action").isin(*ACTIVE)).alias("active_buyers"), F.max("weight").alias("highest_conviction"))
    classes = p.groupBy("company", "cusip").agg(F.count(F.lit(1)).alias("o"), F.count_if(F.col("action").isin(*ACTIVE)).alias("a"), F.max("weight").alias("c"), F.min("issuer").alias("issuer"))
    primary = classes.groupBy("company").agg(F.max(F.struct("o", "a", "c", "cusip", "issuer")).alias("b"), F.count(F.lit(1)).alias("share_classes"))
    return merged.join(primary, "company").select("company", F.col("b.cusip").alias("primary_cusip"), F.col("b.issuer").alias("issuer"), "share_classes", "owners", "active_buyers", "highest_conviction")


def holding_conviction(holdings: DataFrame, top: int = 12) -> DataFrame:
    """From raw holdings to the companies that fresh buying, agreement and conviction put first."""
    from tidemark.operators.sets import global_position
    companies = dedupe_companies(manager_positions(consolidate(holdings)))
    return companies.orderBy(*idea_order(), "company").limit(top)


def resolve_identity(candidates: DataFrame, key: str = "instrument", ident: str = "figi", eligible: str = "eligible") -> DataFrame:
    """A key is resolved only when exactly one distinct eligible identifier exists."""
    ok = F.when(F.col(eligible) & F.col(ident).isNotNull(), F.col(ident))
    per = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.min(ok).alias("_lo"), F.max(ok).alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    return per.select(key, "candidates", F.when(F.col("_lo").isNull(), "unresolved").when(one, "resolved").otherwise("ambiguous").alias("status"), F.when(one, F.col("_lo")).alias(ident))
