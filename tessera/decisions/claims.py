"""Claim constraints as predicates: what a claim must state, and what contradicts it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (code, outcome, condition) of each constraint; refusals beat requests for clarification.
SHAPES: list[tuple[str, str, Column]] = []


def shapes() -> list[tuple[str, str, Column]]:
    """Constraints over period, revenue_type, refund_treatment, reported_as and recognition."""
    if not SHAPES:
        c = F.col
        SHAPES.extend([
            ("gross_reported_as_net", "refuse", (c("revenue_type") == "gross") & (c("reported_as") == "net")),
            ("deferred_reported_as_recognized_net", "refuse", (c("revenue_type") == "deferred") & (c("recognition") == "recognized") & (c("reported_as") == "net")),
            ("period_required", "clarify", c("period").isNull()),
            ("revenue_type_required", "clarify", c("revenue_type").isNull()),
            ("refund_treatment_required", "clarify", (c("revenue_type") == "net") & c("refund_treatment").isNull()),
        ])
    return SHAPES


def validate_claims(claims: DataFrame) -> DataFrame:
    """Adds ``outcome`` (valid, clarify, refuse) and ``violations`` (sorted codes) to every claim."""
    hit = [(code, outcome, F.coalesce(test, F.lit(False))) for code, outcome, test in shapes()]
    codes = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, _, test in hit])))
    any_ = lambda kind: reduce(Column.__or__, [test for _, outcome, test in hit if outcome == kind])
    return claims.withColumn("outcome", F.when(any_("refuse"), "refuse").when(any_("clarify"), "clarify").otherwise("valid")).withColumn("violations", codes)
