"""Evidence packs put together from subclaims, the decisions that rest on them, and what became of both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from tessera.decisions import calibration, context, packs
from tessera.decisions.ledger import Ledger
from tessera.errors import Clarify, Refusal
from tessera.functions.hashing import content_id, digest

#: Names of trust tiers 1 to 3 among the tiers of evidence.
TIER_NAMES = {1: "anecdotal", 2: "observational", 3: "correlational"}
_OUTCOMES = {"answer": "valid", "answer_with_caveats": "valid", "clarify": "clarify", "review_required": "clarify", "refuse": "refuse"}


def compose(engine, terms: Mapping[str, context.Term], subclaims: Sequence[Mapping[str, Any]], action: str, reference_date: str, bars: Sequence[tuple[str, str]] = (), triggers: Sequence[str] = ()) -> dict[str, Any]:
    """A pack: every subclaim {term, claim, tenant, group, ...} asked, and one decision over all of them.

    ``bars`` are the tiers that actions need, by pattern; a subclaim whose term matches one of ``triggers`` needs review;
    subclaims of one group must have one grain and period.
    """
    if not subclaims:
        raise Refusal("pack_empty", action)
    rows, asked = [], []
    for s in subclaims:
        more = {k: v for k, v in s.items() if k not in ("term", "group")}
        try:
            got = context.context_query(engine, terms, s["term"], reference_date, **more)
        except (Clarify, Refusal) as e:
            got = {"answer": "clarify" if isinstance(e, Clarify) else "refuse", "reason_code": e.code}
        tier = TIER_NAMES.get(got.get("trust", {}).get("evidence_tier"))
        asked.append({"term": s["term"], "answer": got["answer"], "reason_code": got.get("reason_code"), "tier": tier, "answer_id": got.get("answer_id")})
        rows.append(("p", _OUTCOMES[got["answer"]], tier, any(packs.matches(s["term"], t) for t in triggers), s.get("group"), s.get("grain"), s.get("period") or (s.get("claim") or {}).get("period")))
    table = engine.spark.createDataFrame(rows, "pack_id string, outcome string, tier string, triggered boolean, group_id string, grain string, period string")
    bar = engine.spark.createDataFrame([("p", packs.tier_bar(action, list(bars)))], "pack_id string, needed_tier string")
    gate = packs.gate(table, bar).first()
    apart = [r.asDict() for r in packs.comparable(table).where("not comparable").orderBy("group_id").collect()]  # a pack has some subclaims
    decision = "review_required" if apart and gate["decision"] == "answer" else gate["decision"]
    reasons = [r for r in gate["reasons"].split(",") if r] + ["groups_not_comparable"] * bool(apart)
    body = {"action": action, "subclaims": asked, "decision": decision, "tier": gate["min_tier"], "reasons": reasons, "contract_hash": engine.contract.hash, "policy_hash": policy_hash(engine, bars)}
    request = {"subclaims": [dict(s) for s in subclaims], "action": action, "reference_date": reference_date, "bars": [list(b) for b in bars], "triggers": list(triggers)}
    return {"pack_id": content_id("pack-", body), **body, "request": request, "not_comparable": apart}


def policy_hash(engine, bars: Sequence[tuple[str, str]]) -> str:
    return digest([list(map(dict, engine.policy)), [list(b) for b in bars]])


def record_decision(ledger: Ledger, pack: Mapping[str, Any], chosen: str, at: datetime, contract_hash: str) -> str:
    """Append a decision on a pack; its id follows from its content. A pack of another contract has expired."""
    if pack["contract_hash"] != contract_hash:
        raise Refusal("pack_expired", pack["pack_id"])
    if pack["decision"] == "refuse":
        raise Refusal("pack_refused", pack["pack_id"])
    payload = {"pack": {k: v for k, v in pack.items() if k != "not_comparable"}, "chosen": chosen}
    event = {"artifact_type": "decision", "source_id": pack["action"], "payload": payload, "edges": [(pack["pack_id"], chosen, "decides")], "evidence_tier": pack["tier"], "recorded_at": at, "contract_hash": contract_hash}
    return ledger.append([event])[0]


def record_outcome(ledger: Ledger, decision_id: str, observed: Mapping[str, Any], at: datetime) -> str:
    """Append what was observed after a decision that the ledger has."""
    found = ledger.get(decision_id)
    if not found or found["artifact_type"] != "decision":
        raise Refusal("decision_unknown", decision_id)
    event = {"artifact_type": "outcome", "source_id": found["source_id"], "payload": {"decision_id": decision_id, "observed": dict(observed)}, "edges": [(decision_id, "outcome", "observed")], "recorded_at": at, "contract_hash": found["contract_hash"]}
    return ledger.append([event])[0]


def replay(engine, terms: Mapping[str, context.Term], pack: Mapping[str, Any]) -> dict[str, Any]:
    """The pack asked again as it was, and what has changed: contract, policy, decision, tier."""
    again = compose(engine, terms, **pack["request"])
    return {"pack": again, "changed": calibration.drift(dict(pack), again)}


def counterfactual(engine, terms: Mapping[str, context.Term], pack: Mapping[str, Any], change: Mapping[str, Any]) -> dict[str, Any]:
    """The pack asked under another configuration: ``change`` is merged into its request; tier bars go by pattern."""
    request = dict(pack["request"])
    bars = {p: t for p, t in request.get("bars", ())} | {p: t for p, t in change.get("bars", ())}
    merged = calibration.overlay(request, {k: v for k, v in change.items() if k != "bars"}) | {"bars": [list(b) for b in bars.items()]}
    again = compose(engine, terms, **merged)
    return {"pack": again, "request_hash": digest(merged), "changed": calibration.drift(dict(pack), again)}
