"""Metric packs: metrics over roles instead of fields, resolved through tiers, bound to a contract, and computed."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Clarify, Issue, Refusal
from tessera.plans.contract import Contract

#: Words for and against a field in a role, with the aggregates a role allows.
ROLES: dict[str, dict[str, tuple[str, ...]]] = {
    "gross_amount": {"for": ("monetary value", "gross", "total price", "total amount"), "against": ("discount", "tax")},
    "discount_amount": {"for": ("discount",), "against": ("price",)},
    "quantity": {"for": ("number of units", "units ordered", "quantity"), "against": ("price",)},
    "order_id": {"for": ("unique identifier for each order", "order number"), "against": ()},
    "customer_id": {"for": ("identifier for the buyer", "identifier of the customer"), "against": ()},
    "order_status": {"for": ("fulfillment state", "state of the order"), "against": ()},
}
#: Metrics of the two pack tiers: terms (sign, aggregate, role) of a sum or difference, or numerator and denominator.
GLOBAL_PACK: dict[str, dict[str, Any]] = {
    "units": {"kind": "sum", "terms": [("+", "sum", "quantity")], "aliases": ("units sold", "volume")},
    "gross_revenue": {"kind": "sum", "terms": [("+", "sum", "gross_amount")], "aliases": ("sales", "revenue")},
    "net_revenue": {"kind": "difference", "terms": [("+", "sum", "gross_amount"), ("-", "sum", "discount_amount")], "aliases": ("revenue after discounts",)},
    "average_order": {"kind": "ratio", "terms": [("+", "sum", "gross_amount"), ("/", "count", "order_id")], "aliases": ("aov", "average order value")},
}
INDUSTRY_PACKS: dict[str, dict[str, dict[str, Any]]] = {"retail": {"sales": {"delegates_to": "gross_revenue", "aliases": ("turnover",)}}}


def normal(term: str) -> str:
    """Lower case words joined by underscores, each without a plural s."""
    return "_".join(w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", term.casefold()))


@dataclass(frozen=True)
class Resolved:
    metric_id: str
    tier: str
    spec: Mapping[str, Any] = field(default_factory=dict)


def resolve_metric(contract: Contract, term: str, industry: str | None = None, use_packs: bool = False) -> Resolved:
    """Tiers in order: exact id, normalised label, industry pack, global pack (packs only when asked for), else clarify."""
    metrics = contract.data["metrics"]
    if term in metrics:
        return Resolved(term, "exact", metrics[term])
    for k, m in metrics.items():
        if normal(term) in (normal(k), normal(m["label"])):
            return Resolved(k, "normalised", m)
    if use_packs:
        for tier, pack in (("industry", INDUSTRY_PACKS.get(industry or "", {})), ("global", GLOBAL_PACK)):
            for k, spec in pack.items():
                if normal(term) in {normal(k), *map(normal, spec.get("aliases", ()))}:
                    while "terms" not in spec:  # an industry's name for a global metric
                        spec = {**GLOBAL_PACK[spec["delegates_to"]]}
                    return Resolved(k, tier, spec)
    raise Clarify("metric_unknown", term, sorted(metrics))


def map_role(contract: Contract, role: str, least: int = 1, margin: int = 1) -> str:
    """The one field whose description speaks for the role, ahead of the next by ``margin``."""
    words = ROLES.get(role)
    if words is None:
        raise Refusal("role_unmapped", role)
    points = []
    for k, f in {**contract.data["measures"], **contract.data["dimensions"]}.items():
        low = f["description"].casefold()
        points.append((0 if any(w in low for w in words["against"]) else sum(w in low for w in words["for"]), k))
    points.sort(key=lambda x: (-x[0], x[1]))
    if not points or points[0][0] < least:
        raise Refusal("role_unmapped", role)
    if len(points) > 1 and points[0][0] - points[1][0] < margin:
        raise Refusal("role_ambiguous", role, candidates=[k for p, k in points if p == points[0][0]])
    return points[0][1]


def bound_terms(contract: Contract, spec: Mapping[str, Any]) -> list[tuple[str, str, str]]:
    return [(sign, agg, map_role(contract, role)) for sign, agg, role in spec["terms"]]


def verify_plan(contract: Contract, spec: Mapping[str, Any], plan: Mapping[str, Any], default_filter: tuple[str, Any] | None = None) -> dict[str, Any]:
    """Whether a plan computes the metric: its aggregates must be the formula's terms (for a ratio, contain them) and
    its filters must have the default one; another value of that is a caveat."""
    want = {(agg, f) for _, agg, f in bound_terms(contract, spec)}
    have = {(s["aggregation"], s["field"]) for s in plan.get("select", ()) if s.get("aggregation")}
    if not (want <= have if spec["kind"] == "ratio" else want == have):
        raise Refusal("metric_formula_mismatch", f"plan has {sorted(have)}, metric {sorted(want)}")
    caveats = []
    if default_filter:
        values = [f.get("value") for f in plan.get("filters", ()) if f["field"] == default_filter[0]]
        if not values:
            raise Refusal("metric_default_filter_missing", default_filter[0])
        if default_filter[1] not in values:
            caveats.append("default_filter_overridden")
    return {"formula_verified": spec["kind"] == "sum" and len(want) == 1, "caveats": caveats}


def pack_metric(spark: SparkSession, contract: Contract, spec: Mapping[str, Any], group_by: str | None = None, name: str = "value") -> DataFrame:
    """The metric's value, computed in one aggregation; a ratio with a zero denominator is null."""
    terms = bound_terms(contract, spec)
    tables = {contract.field(f)["table"] for *_, f in terms} | ({contract.field(group_by)["table"]} if group_by else set())
    if len(tables) > 1:
        raise Refusal("metric_spans_tables", ", ".join(sorted(tables)))
    df = contract.table(spark, tables.pop())
    parts = [{"sum": F.sum, "count": F.count, "avg": F.avg}[agg](contract.field(f)["column"]) for _, agg, f in terms]
    value = parts[0]
    for (sign, _, _), part in zip(terms[1:], parts[1:], strict=True):
        value = F.try_divide(value, part) if sign == "/" else value - part if sign == "-" else value + part
    keys = [F.col(contract.field(group_by)["column"])] if group_by else []
    return df.groupBy(*keys).agg(value.alias(name))


def check_pack(pack: Mapping[str, Any]) -> list[Issue]:
    """Malformed metrics of a pack."""
    out = []
    for k, spec in pack.items():
        if "delegates_to" in spec:
            continue
        if spec.get("kind") not in ("sum", "difference", "ratio"):
            out.append(Issue("pack_kind_unknown", k, str(spec.get("kind"))))
        for term in spec.get("terms") or [None]:
            if not (isinstance(term, (list, tuple)) and len(term) == 3):
                out.append(Issue("pack_term_malformed", k, str(term)))
                continue
            sign, agg, role = term
            if sign not in "+-/":
                out.append(Issue("pack_sign_unknown", k, sign))
            if agg not in ("sum", "count", "avg"):
                out.append(Issue("pack_aggregation_unknown", k, agg))
            if role not in ROLES:
                out.append(Issue("pack_role_unknown", k, role))
    return out
