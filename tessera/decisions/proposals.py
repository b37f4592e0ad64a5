"""Proposals to trust a term less: recorded from calibration, then approved or rejected, and read back as overrides."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.decisions.calibration import latest, proposals
from tessera.decisions.ledger import Ledger
from tessera.errors import Refusal

PROPOSAL, VERDICT = "trust_proposal", "proposal_verdict"
VERDICTS = ("approved", "rejected")


def propose(ledger: Ledger, calibrated: DataFrame, at: datetime, contract_hash: str | None = None, **limits: Any) -> list[str]:
    """Record a proposal for each term of ``calibrated``, an aggregate by term, that misses too often; their ids.

    There is at most one row a term here, and terms are declared, so the rows are few.
    """
    rows = proposals(calibrated, **limits).orderBy("term").collect()
    events = [{"artifact_type": PROPOSAL, "source_id": r["term"], "payload": {"term": r["term"], "n": r["n"], "miss_low": round(r["miss_low"], 6)}, "recorded_at": at, "contract_hash": contract_hash} for r in rows]
    return ledger.append(events) if events else []


def decide(ledger: Ledger, proposal_id: str, verdict: str, operator: str, at: datetime) -> str:
    """Record the one verdict on a proposal; the id of its record."""
    if verdict not in VERDICTS:
        raise Refusal("verdict_unknown", verdict)
    found = ledger.get(proposal_id)
    if found is None or found["artifact_type"] != PROPOSAL:
        raise Refusal("proposal_unknown", proposal_id)
    if ledger.lineage().where((F.col("to_id") == proposal_id) & (F.col("kind") == "decides")).take(1):
        raise Refusal("proposal_decided", proposal_id)
    payload = {"proposal_id": proposal_id, "term": found["source_id"], "verdict": verdict, "operator": operator}
    event = {"artifact_type": VERDICT, "source_id": found["source_id"], "payload": payload, "edges": [(operator, proposal_id, "decides")], "recorded_at": at, "contract_hash": found["contract_hash"]}
    return ledger.append([event])[0]


def overrides(ledger: Ledger) -> dict[str, dict[str, Any]]:
    """Overrides for load_terms(): terms whose last verdict approved a proposal lose their certification."""
    said = ledger.all().where(F.col("artifact_type") == VERDICT).select(F.col("source_id").alias("term"), F.get_json_object("payload", "$.verdict").alias("verdict"), "recorded_at")
    return {r["term"]: {"certified": False} for r in latest(said, "term").where("verdict = 'approved'").collect()}
