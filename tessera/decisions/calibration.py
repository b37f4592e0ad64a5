"""Calibration: how decisions turned out, with intervals, and proposals where trust should fall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import Refusal
from tessera.functions.stats import wilson

#: Most rules with a glob that are tried against every decision.
GLOBS = 10_000
#: Numeric outcomes within this distance match.
TOLERANCE = 0.01


def deltas(expected: DataFrame, observed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(decision_id, matched, checks, delta) of expected and observed (decision_id, field, value string).

    Numbers match within the tolerance, others exactly, and nothing observed is no match. delta is match, partial or
    miss: all, some or none of a decision's fields match.
    """
    both = expected.select("decision_id", "field", F.col("value").alias("__want")).join(observed.select("decision_id", "field", F.col("value").alias("__got")), ["decision_id", "field"], "left")
    want, got = F.expr("try_cast(__want as double)"), F.expr("try_cast(__got as double)")
    ok = F.when(want.isNotNull() & got.isNotNull(), F.abs(want - got) <= tolerance).otherwise(F.col("__want").eqNullSafe(F.col("__got")))
    out = both.groupBy("decision_id").agg(F.count_if(ok).alias("matched"), F.count(F.lit(1)).alias("checks"))
    return out.withColumn("delta", F.when(F.col("matched") == F.col("checks"), "match").when(F.col("matched") > 0, "partial").otherwise("miss"))


def aggregate(scored: DataFrame, *keys: str) -> DataFrame:
    """n, matches, match_rate with its Wilson interval, and the lower bound of the miss rate; partial counts as a miss."""
    out = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") == "match").alias("matches"))
    low, high = wilson(F.col("matches"), F.col("n"))
    miss_low, _ = wilson(F.col("n") - F.col("matches"), F.col("n"))
    return out.withColumns({"match_rate": F.col("matches") / F.col("n"), "match_low": low, "match_high": high, "miss_low": miss_low})


def proposals(calibrated: DataFrame, min_n: int = 10, threshold: float = 0.2) -> DataFrame:
    """Rows whose misses are too many to be chance: n at least min_n and the miss rate's lower bound above the threshold."""
    return calibrated.where((F.col("n") >= min_n) & (F.col("miss_low") > threshold))


def latest(records: DataFrame, key: str, when: str = "recorded_at") -> DataFrame:
    """The last record of each key, by one aggregation."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, *[c for c in rest if c != when])).alias("r")).select(key, "r.*")


def advised(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """(decision_id, target_term) where a rule's pattern (pattern, target_term) equals, or as a glob matches, a decision's
    term or action.

    Plain patterns, however many, meet decisions by equality. Globs must be tried one by one: more than GLOBS of them
    are refused, as their list is broadcast."""
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("pattern", r"([.\\+^$(){}|\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    is_glob = F.col("pattern").rlike(r"[*?]")
    globs, plain = rules.where(is_glob), rules.where(~is_glob)
    if (n := globs.count()) > GLOBS:
        raise Refusal("too_many_glob_rules", f"{n} globs, {GLOBS} at most")
    named = decisions.select("decision_id", F.explode(F.array("term", "action")).alias("pattern"))
    found = named.join(plain, "pattern").select("decision_id", "target_term")
    return found.union(decisions.join(F.broadcast(globs), F.rlike("term", glob) | F.rlike("action", glob)).select("decision_id", "target_term")).distinct()


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(decision_id, changed) of recorded and replayed decisions (decision_id, contract_hash, policy_hash, decision,
    tier): what differs, or 'missing' where a decision could not be replayed, joined by commas; '' where nothing does."""
    names = ("contract_hash", "policy_hash", "decision", "tier")
    other = after.select("decision_id", F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in names])
    both = before.select("decision_id", *names).join(other, "decision_id", "left")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in names])), ",")
    return both.select("decision_id", F.when(F.col("__there").isNull(), "missing").otherwise(changed).alias("changed"))


def drift(before: dict, after: dict) -> list[str]:
    """What a replay changed: contract, policy, decision, tier."""
    return [k for k in ("contract_hash", "policy_hash", "decision", "tier") if before.get(k) != after.get(k)]


def overlay(base: dict, change: dict) -> dict:
    """base with change merged in, mappings key by key: the configuration of a counterfactual."""
    out = dict(base)
    for k, v in change.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
