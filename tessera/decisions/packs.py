"""Evidence packs: several subclaims, one decision."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Evidence tiers from weakest to strongest.
TIERS = ("anecdotal", "observational", "correlational", "quasi_experimental", "experimental", "replicated", "established")


def matches(name: str, pattern: str) -> bool:
    """Equality, a glob, or ``prefix:`` of the name."""
    return name == pattern or fnmatchcase(name, pattern) or pattern.endswith(":") and name.startswith(pattern)


def tier_bar(action: str, bars: list[tuple[str, str]], default: str = TIERS[0]) -> str:
    """Tier that an action needs: the first pattern that matches."""
    return next((tier for pattern, tier in bars if matches(action, pattern)), default)


def tier_rank(column: str) -> F.Column:
    out = F.lit(None).cast("int")
    for k, t in enumerate(TIERS):
        out = F.when(F.col(column) == t, F.lit(k)).otherwise(out)
    return out


def gate(subclaims: DataFrame, bars: DataFrame) -> DataFrame:
    """(pack_id, n, min_tier, decision, reasons) of (pack_id, outcome, tier, triggered), bars (pack_id, needed_tier).

    refuse if a subclaim is refused; else review_required on a subclaim to clarify, a trigger, or a weakest tier (no
    tier counts as weakest) below the bar; else answer.
    """
    each = subclaims.withColumn("__rank", F.coalesce(tier_rank("tier"), F.lit(0)))
    packs = each.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("__rank").alias("__least"), F.max(F.col("outcome") == "refuse").alias("__refused"), F.max(F.col("outcome") == "clarify").alias("__unclear"),
        F.max(F.coalesce("triggered", F.lit(False))).alias("__triggered"),
    )
    packs = packs.join(bars.select("pack_id", F.coalesce(tier_rank("needed_tier"), F.lit(0)).alias("__need")), "pack_id", "left")
    low = F.col("__least") < F.coalesce("__need", F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in ((F.col("__refused"), "subclaim_refused"), (F.col("__unclear"), "subclaim_unclear"), (F.col("__triggered"), "review_trigger"), (low, "tier_below_bar"))]))
    decision = F.when(F.col("__refused"), "refuse").when(F.col("__unclear") | F.col("__triggered") | low, "review_required").otherwise("answer")
    return packs.select("pack_id", "n", F.element_at(F.array(*map(F.lit, TIERS)), F.col("__least") + 1).alias("min_tier"), decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


def comparable(subclaims: DataFrame) -> DataFrame:
    """(group_id, n, comparable, reason): the subclaims of a group must have one grain and one period, all stated."""
    groups = subclaims.where("group_id is not null").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("grain").alias("__g"), F.count_distinct("period").alias("__p"), F.count_if(F.col("grain").isNull() | F.col("period").isNull()).alias("__open")
    )
    reason = F.when(F.col("__open") > 0, "incomplete").when(F.col("n") < 2, "single_member").when(F.col("__g") > 1, "grain_differs").when(F.col("__p") > 1, "period_differs").otherwise("")
    return groups.select("group_id", "n", (reason.isin("", "single_member")).alias("comparable"), reason.alias("reason"))
