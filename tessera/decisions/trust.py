"""Trust in terms: evidence tier, drift, status. Batch forms are columns over a DataFrame of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import normal_interval

#: Statuses and drift states.
STATUSES, DRIFTS = ("trusted", "usable_with_caveats", "not_usable"), ("current", "at_risk", "expired")


def trust_signals(terms: DataFrame, reference_date: str, warn_share: float = 0.8) -> DataFrame:
    """Adds age_days, drift, evidence_tier and status to (term_id, certified, probe_ok, verified_on, max_age_days).

    Tier 3: certified and its probe returned rows; 2: certified; 1: neither. Drift is expired beyond max_age_days (or
    never verified), at_risk beyond ``warn_share`` of it. Expired or tier 1 terms aren't usable; tier 3 and current ones
    are trusted.
    """
    age = F.date_diff(F.lit(reference_date).cast("date"), F.col("verified_on").cast("date"))
    drift = F.when(F.col("age_days").isNull() | (F.col("age_days") > F.col("max_age_days")), "expired").when(F.col("age_days") > F.col("max_age_days") * warn_share, "at_risk").otherwise("current")
    certified, probed = F.coalesce("certified", F.lit(False)), F.coalesce("probe_ok", F.lit(False))
    tier = F.when(certified & probed, 3).when(certified, 2).otherwise(1)
    status = F.when((F.col("drift") == "expired") | (F.col("evidence_tier") == 1), "not_usable").when((F.col("evidence_tier") == 3) & (F.col("drift") == "current"), "trusted").otherwise("usable_with_caveats")
    return terms.withColumn("age_days", age.cast("long")).withColumn("drift", drift).withColumn("evidence_tier", tier.cast("long")).withColumn("status", status)


def pass_rates(runs: DataFrame, *keys: str) -> DataFrame:
    """n, passes, rate and its normal 95 % interval of (..., passed)."""
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passes"))
    low, high = normal_interval(F.col("passes"), F.col("n"))
    return out.withColumn("rate", F.col("passes") / F.col("n")).withColumn("low", low).withColumn("high", high)


def consistency(runs: DataFrame) -> DataFrame:
    """pass^k of (question, expected, decision): questions all of whose repeats gave the expected decision."""
    each = runs.groupBy("question").agg(F.count(F.lit(1)).alias("k"), F.bool_and(F.col("decision").eqNullSafe(F.col("expected"))).alias("consistent"))
    return each.agg(F.count(F.lit(1)).alias("questions"), F.count_if("consistent").alias("consistent"), F.avg(F.col("consistent").cast("double")).alias("pass_k"))
