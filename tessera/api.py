"""Tools: every entry point passes the role gate, answers with status ok, clarify or refused, and reads masked tables."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import wraps
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.decisions import claims, context, record
from tessera.decisions.ledger import Ledger
from tessera.errors import Clarify, Refusal
from tessera.functions.hashing import content_id, digest
from tessera.metrics import compiler, freshness, lineage, resolve
from tessera.metrics.kernel import Kernel
from tessera.operators import access, citations, documents, federation, text_search, vector_search
from tessera.operators.evidence import closure_issues, missing_focus
from tessera.plans import packs, semantic_plan
from tessera.plans.contract import Contract, canonical_json, load
from tessera.plans.guard import guarded_sql
from tessera.plans.roles import columns_with
from tessera.plans.rules import recorded
from tessera.sources.registry import check_config, load_sources

#: Other names of tools.
ALIASES = {"execute_postgres_semantic_query": "execute_semantic_query", "run_guarded_postgres_sql": "run_guarded_sql"}
TOOLS: dict[str, Callable] = {}


def tool(method):
    """Gate, run, and turn refusals and questions into answers."""

    @wraps(method)
    def run(self, *args, **kwargs):
        try:
            access.require_tool(self.roles, self.role, method.__name__)
            return {"status": "ok", **method(self, *args, **kwargs), "trace_id": self.trace_id}
        except (Refusal, Clarify) as e:
            return {**e.as_dict(), "trace_id": self.trace_id}

    TOOLS[method.__name__] = run
    return run


@dataclass
class Engine:
    """A session, a contract, and who is asking. Results are DataFrames under ``rows``; rows() collects an answer."""

    spark: SparkSession
    contract: Contract
    role: str | None = None
    roles: Mapping[str, Any] | None = None
    masking: access.Masking = field(default_factory=access.Masking)
    kernel: Kernel | None = None
    policy: Sequence[Mapping[str, Any]] = ()
    certificates: Sequence[Mapping[str, Any]] = ()
    terms: Mapping[str, context.Term] = field(default_factory=dict)
    ledger: Ledger | None = None
    trace_id: str = ""

    @property
    def seen(self) -> Contract:
        """The contract as the role sees it: every tool reads its tables through it."""
        return self.contract.seen_by(self.masking, self.role)

    def _cited(self, df: DataFrame, source_id: str, fields: Sequence[str], identity: Sequence[str] = (), **more: Any) -> dict[str, Any]:
        record = citations.provenance(self.contract, source_id, fields, **more)
        there = [c for c in identity if c in df.columns]
        return {"rows": citations.cite(self.masking.result(df, self.role), record, there), "provenance": record, "rule_impact": citations.rule_impact(self.contract, sorted({self.contract.field(f)["table"] for f in fields}))}

    def call(self, name: str, **kwargs: Any) -> dict[str, Any]:
        name = ALIASES.get(name, name)
        if name not in TOOLS:
            return Refusal("tool_unknown", name, tools=sorted(TOOLS)).as_dict()
        return TOOLS[name](self, **kwargs)

    @tool
    def list_sources(self) -> dict[str, Any]:
        return {"sources": self.contract.sources.listing(), "capabilities": self.contract.sources.capability_map()}

    @tool
    def health_check(self) -> dict[str, Any]:
        found = [s.health(self.spark) for s in self.contract.sources.by_id.values()]
        return {"sources": found, "healthy": all(x["status"] != "error" for x in found)}

    @tool
    def get_semantic_contract(self) -> dict[str, Any]:
        return {"contract": self.contract.data, "issues": [i.__dict__ for i in self.contract.issues], "policies": recorded(self.contract.data)}

    @tool
    def execute_semantic_query(self, plan: Mapping[str, Any], metric: str | None = None, use_packs: bool = False) -> dict[str, Any]:
        stamp = {}
        if metric:
            found = packs.resolve_metric(self.contract, metric, use_packs=use_packs)
            stamp = {"metric": {"metric_id": found.metric_id, "tier": found.tier, **(packs.verify_plan(self.contract, found.spec, plan) if "terms" in found.spec else {})}}
        df = semantic_plan.compile_plan(self.spark, self.seen, plan)
        fields = sorted({s["field"] for s in plan["select"]} | {f["field"] for f in plan.get("filters") or ()})
        grouped = any(s.get("aggregation") for s in plan["select"])
        names = [s.get("alias") or self.contract.field(s["field"])["column"] for s in plan["select"] if s["field"] in (plan.get("group_by") or ())]
        identity = names if grouped else [i for t in {self.contract.field(f)["table"] for f in fields} for i in columns_with(self.contract.data, t, "identity", "join_key")]
        return {**self._cited(df, self.contract.field(fields[0])["source"], fields, identity, filters=list(plan.get("filters") or ()), joins=list(plan.get("joins") or ())), **stamp}

    @tool
    def run_guarded_sql(self, sql: str, limit: int | None = None, citation_mode: str = "exploratory", purpose: str | None = None, strict: bool = False) -> dict[str, Any]:
        df, facts = guarded_sql(self.spark, self.seen, sql, limit, strict, citation_mode, purpose)
        source = self.contract.owners()[facts["tables"][0]]
        fields = facts["fields"] or [next(iter(self.contract.data["tables"][facts["tables"][0]]["columns"].values()))]
        return {**self._cited(df, source, fields, may_support_claims=facts["may_support_claims"]), "facts": facts}

    @tool
    def query_documents(self, table: str, **request: Any) -> dict[str, Any]:
        df = documents.query_documents(self.spark, self.seen, table, **request)
        return self._table_answer(df, table)

    @tool
    def search_text(self, table: str, **request: Any) -> dict[str, Any]:
        return self._table_answer(text_search.search_text(self.spark, self.seen, table, **request), table)

    @tool
    def search_vector(self, table: str, **request: Any) -> dict[str, Any]:
        return self._table_answer(vector_search.search_vector(self.spark, self.seen, table, **request), table)

    def _table_answer(self, df: DataFrame, table: str) -> dict[str, Any]:
        entry = self.contract.data["tables"][table]
        return self._cited(df, entry["source"], [f for c, f in entry["columns"].items() if c in df.columns], columns_with(self.contract.data, table, "identity"))

    @tool
    def combine_slices(self, left: DataFrame, right: DataFrame, left_key: str, right_key: str, **options: Any) -> dict[str, Any]:
        df = federation.combine_slices(left, right, left_key, right_key, contract=self.contract, **options)
        return {"rows": self.masking.result(df, self.role), "may_support_claims": federation.may_support(df)}

    @tool
    def validate_analysis_request(self, request: dict) -> dict[str, Any]:
        missing = missing_focus(request)
        return {"complete": not missing, "missing": missing}

    @tool
    def validate_cited_evidence_packet(self, claims: DataFrame, citations: DataFrame, envelopes: DataFrame) -> dict[str, Any]:
        issues = closure_issues(claims, citations, envelopes, self.contract.hash)
        return {"issues": issues, "closed": not issues.take(1)}

    def _kernel(self) -> Kernel:
        if self.kernel is None:
            raise Refusal("kernel_missing", "no metric kernel is loaded")
        return self.kernel

    @tool
    def metric_query(self, term: str, tenant: str | None = None, industry: str | None = None, reference_date: str | None = None, **request: Any) -> dict[str, Any]:
        """Resolve, check policy and freshness, compile, answer."""
        k = self._kernel()
        from tessera.metrics.certify import stale

        found = resolve.resolve(k, term, tenant, industry, stale(k, self.certificates))
        verdict = access.decide(self.policy, {"role": self.role or "", "operation": "metric_query", "metric": found.metric.id, "source": ""})
        if self.ledger is not None:
            asked = {"role": self.role, "operation": "metric_query", "metric": found.metric.id}
            self.ledger.append([{"artifact_type": "policy_decision", "source_id": "policy", "payload": {**asked, **verdict}, "recorded_at": datetime.now(), "contract_hash": self.contract.hash}])
        if not verdict["allowed"]:
            raise Refusal("policy_denied", verdict["rule_id"])
        table = lambda t: self.seen.table(self.spark, t)
        made = compiler.compile_metric(k, table, found.metric, reference_date=reference_date, **request)
        caveats = [*found.caveats, *made.caveats]
        if reference_date:
            e = k.entities[made.entity]
            caveats += freshness.require_fresh(k, found.metric, table(e.table), e.time_field, reference_date)
        plan = {"metric": found.metric.id, "hash": found.metric.definition_hash, "request": {**request, "reference_date": reference_date}}
        return {"rows": self.masking.result(made.df, self.role), "metric_id": found.metric.id, "caveats": caveats, "answer_id": content_id("ans-", plan), "plan_id": f"plan-{digest([self.contract.hash, plan], 12)}", "relations": made.relations}

    @tool
    def list_terms(self) -> dict[str, Any]:
        return {"terms": sorted({m.name for m in self._kernel().metrics.values()})}

    @tool
    def describe_metric(self, metric_id: str) -> dict[str, Any]:
        m = self._kernel().metrics.get(metric_id)
        if m is None:
            raise Clarify("metric_unknown", metric_id, sorted(self._kernel().metrics))
        return {"metric": m.__dict__, "definition_hash": m.definition_hash}

    def _terms(self) -> Mapping[str, context.Term]:
        self._kernel()
        return self.terms

    @tool
    def context_query(self, term: str, reference_date: str, claim: Mapping[str, Any] | None = None, **request: Any) -> dict[str, Any]:
        return context.context_query(self, self._terms(), term, reference_date, claim, **request)

    @tool
    def context_card(self, term: str, tenant: str | None = None, industry: str | None = None) -> dict[str, Any]:
        return {"card": context.card(context.resolve_term(self._terms(), self._kernel(), term, tenant, industry), self._kernel())}

    @tool
    def context_facets(self) -> dict[str, Any]:
        return {"facets": context.facets(self._terms())}

    @tool
    def export_semantic_model(self) -> dict[str, Any]:
        return {"model": context.export_model(self._kernel(), self.terms)}

    @tool
    def describe_constraints(self) -> dict[str, Any]:
        return {"constraints": [{"code": code, "outcome": outcome} for code, outcome, _ in claims.shapes()], "fields": list(context.CLAIM_FIELDS)}

    @tool
    def compose_evidence_pack(self, subclaims: Sequence[Mapping[str, Any]], action: str, reference_date: str, bars: Sequence[tuple[str, str]] = (), triggers: Sequence[str] = ()) -> dict[str, Any]:
        return {"pack": record.compose(self, self._terms(), subclaims, action, reference_date, bars, triggers)}

    def _ledger(self) -> Ledger:
        if self.ledger is None:
            raise Refusal("ledger_missing", "no ledger is set")
        return self.ledger

    @tool
    def record_decision(self, pack: Mapping[str, Any], chosen: str, at: datetime) -> dict[str, Any]:
        return {"decision_id": record.record_decision(self._ledger(), pack, chosen, at, self.contract.hash)}

    @tool
    def record_outcome(self, decision_id: str, observed: Mapping[str, Any], at: datetime) -> dict[str, Any]:
        return {"outcome_id": record.record_outcome(self._ledger(), decision_id, observed, at)}

    @tool
    def replay_decision(self, pack: Mapping[str, Any]) -> dict[str, Any]:
        return record.replay(self, self._terms(), pack)

    @tool
    def counterfactual(self, pack: Mapping[str, Any], change: Mapping[str, Any]) -> dict[str, Any]:
        return record.counterfactual(self, self._terms(), pack, change)

    @tool
    def metric_lineage(self, metric_id: str) -> dict[str, Any]:
        return {"rows": lineage.closure(lineage.edges(self.spark, self._kernel()), [f"metric:{metric_id}"])}


def rows(answer: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The rows of an answer, collected: answers are limited to some hundred rows."""
    return [r.asDict(recursive=True) for r in answer["rows"].collect()]


def main(argv: Sequence[str] | None = None) -> int:
    """Command line: validate inputs, write or check the compiled contract, check sources' health."""
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--contract", required=True)
    p.add_argument("--sources", required=True)
    p.add_argument("--validate", action="store_true")
    p.add_argument("--write", metavar="FILE")
    p.add_argument("--check", metavar="FILE")
    p.add_argument("--health-check", action="store_true")
    a = p.parse_args(argv)
    config = Path(a.sources).read_text()
    issues = check_config(config, Path(a.sources).parent)
    if any(i.is_error for i in issues):
        print(json.dumps([i.__dict__ for i in issues], indent=2))
        return 1
    contract = load(Path(a.contract).read_text(), load_sources(config, Path(a.sources).parent))
    issues += contract.issues
    if a.validate:
        print(json.dumps([i.__dict__ for i in issues], indent=2))
    if a.write:
        Path(a.write).write_text(canonical_json(contract.data))
    if a.check and Path(a.check).read_text() != canonical_json(contract.data):
        print("the compiled contract is out of date")
        return 1
    if a.health_check:
        from tessera.session import session

        print(json.dumps([s.health(session()) for s in contract.sources.by_id.values()], indent=2))
    return int(any(i.is_error for i in issues))


if __name__ == "__main__":
    sys.exit(main())
