"""Business terms: what they stand for, whether they can be trusted, and the answer to a question about one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from typing import Any

from tessera.decisions.claims import validate_claims
from tessera.decisions.trust import trust_signals
from tessera.errors import Clarify, Issue, Refusal
from tessera.functions.hashing import digest
from tessera.metrics import formula
from tessera.metrics.kernel import Kernel
from tessera.metrics.paths import join_path

#: Answers of a context query.
ANSWERS = ("answer", "answer_with_caveats", "clarify", "review_required", "refuse")


@dataclass(frozen=True)
class Term:
    """A term of a collection: metrics and entities that it refers to, who owns it, how to use it, and its verification."""

    id: str
    name: str
    collection: str
    aliases: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    owner: str | None = None
    guidance: str | None = None
    certified: bool = False
    verified_on: str | None = None
    max_age_days: int = 365

    @property
    def names(self) -> set[str]:
        return {self.id.casefold(), self.name.casefold(), *(a.casefold() for a in self.aliases)}


def load_terms(raw: Mapping[str, Mapping[str, Any]], kernel: Kernel, overrides: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, Term]:
    """Terms of a mapping {id: settings}; ``overrides`` replace trust settings of terms. Everything wrong is refused at once."""
    known = {f.name for f in fields(Term)} - {"id"}
    issues = [Issue("unknown_setting", f"terms.{k}", x) for k, v in raw.items() for x in sorted(set(v) - known)]
    issues += [Issue("setting_missing", f"terms.{k}", x) for k, v in raw.items() for x in ("name", "collection") if not v.get(x)]
    issues += [Issue("unknown_override", f"overrides.{k}", x) for k, v in (overrides or {}).items() for x in (sorted(set(v) - {"certified", "verified_on", "max_age_days"}) if k in raw else [k])]
    if not issues:
        made = {k: Term(id=k, **{x: tuple(y) if isinstance(y, list) else y for x, y in {**v, **(overrides or {}).get(k, {})}.items()}) for k, v in raw.items()}
        issues = list(_references(made.values(), kernel))
    if issues:
        raise Refusal("TERMS_INVALID", "; ".join(f"{i.where}: {i.detail}" for i in issues), issues=[i.code for i in issues])
    return made


def _references(terms: Iterable[Term], kernel: Kernel) -> Iterable[Issue]:
    taken: dict[tuple[str, str], str] = {}
    for t in terms:
        for section, refs in (("collections", (t.collection,)), ("metrics", t.metrics), ("entities", t.entities)):
            yield from (Issue("unknown_reference", f"terms.{t.id}", f"{section} has no {x}") for x in refs if x not in getattr(kernel, section))
        for name in sorted(t.names):
            if (first := taken.setdefault((t.collection, name), t.id)) != t.id:
                yield Issue("alias_taken", f"terms.{t.id}", f"{name} is a name of {first}")


def resolve_term(terms: Mapping[str, Term], kernel: Kernel, name: str, tenant: str | None = None, industry: str | None = None) -> Term:
    """The term of a name, id or alias, in the collections that apply, by falling priority; without one, ask back."""
    applies = sorted((c for c in kernel.collections.values() if c.tenant in (None, tenant) and c.industry in (None, industry)), key=lambda c: (-c.priority, c.id))
    for c in applies:
        for t in terms.values():
            if t.collection == c.id and name.casefold() in t.names:
                return t
    raise Clarify("term_unknown", name, sorted(t.id for t in terms.values() if t.collection in {c.id for c in applies}))


def card(term: Term, kernel: Kernel) -> dict[str, Any]:
    """What is known of a term: lineage of its metrics, join paths to their dimensions, owner and guidance."""
    lineage, ways = set(), {}

    def trace(kind: str, ref: str) -> None:
        lineage.add(f"{kind}:{ref}")
        if kind == "metric":
            m = kernel.metrics[ref]
            for part in formula.references(m.formula) if m.derived else [("measure", m.measure)]:
                trace(*part)
        else:
            x = kernel.measures[ref]
            e = kernel.entities[x.entity]
            lineage.update((f"entity:{e.id}", f"column:{e.source}.{e.table}.{x.field}"))

    def base(metric: str) -> str:
        m = kernel.metrics[metric]
        kind, ref = formula.references(m.formula)[0] if m.derived else ("measure", m.measure)
        return base(ref) if kind == "metric" else kernel.measures[ref].entity

    for m in term.metrics:
        trace("metric", m)
        for d in kernel.metrics[m].dimensions:
            try:
                ways[f"{m}/{d}"] = [s.relation for s in join_path(kernel, base(m), kernel.dimensions[d].entity)]
            except Refusal:  # a dimension that can't be reached is said to have no way
                ways[f"{m}/{d}"] = None
    body = {"term_id": term.id, "name": term.name, "aliases": sorted(term.aliases), "metrics": list(term.metrics), "entities": list(term.entities), "owner": term.owner, "guidance": term.guidance, "lineage": sorted(lineage), "join_paths": ways}
    return {**body, "card_hash": digest(body)}


def facets(terms: Mapping[str, Term]) -> dict[str, dict[str, int]]:
    """How many terms each collection, owner and certification has."""
    counted = lambda values: dict(sorted(Counter(values).items()))
    every = terms.values()
    return {"collection": counted(t.collection for t in every), "owner": counted(t.owner or "" for t in every), "certified": counted(str(t.certified).lower() for t in every)}


def export_model(kernel: Kernel, terms: Mapping[str, Term]) -> dict[str, Any]:
    """The semantic model in plain JSON values: datasets with fields, relationships, metrics and terms."""
    of = lambda items, entity: [x for x in items.values() if x.entity == entity]
    return {
        "datasets": [{"name": e.id, "source": f"{e.source}.{e.table}", "primary_key": [e.primary_key], "fields": sorted({x.field for x in (*of(kernel.measures, e.id), *of(kernel.dimensions, e.id))})} for e in kernel.entities.values()],
        "relationships": [{"name": r.id, "from": r.left, "to": r.right, "from_columns": [r.left_key], "to_columns": [r.right_key], "cardinality": r.cardinality} for r in kernel.relations.values()],
        "metrics": [{"name": m.id, "label": m.name, "expression": m.formula or f"{kernel.measures[m.measure].aggregation}({m.measure})", "dimensions": list(m.dimensions)} for m in kernel.metrics.values()],
        "terms": [card(t, kernel) for t in terms.values()],
    }


def probe(engine, metric: str, reference_date: str | None) -> bool:
    """Whether the metric runs and gives a row with a value."""
    answer = engine.call("metric_query", term=metric, reference_date=reference_date)
    row = answer["rows"].limit(1).first() if answer["status"] == "ok" else None
    return row is not None and any(v is not None for v in row)


def trust_of(engine, term: Term, reference_date: str) -> dict[str, Any]:
    """The term's trust signals, its first metric being probed."""
    works = bool(term.metrics) and probe(engine, term.metrics[0], reference_date)
    schema = "term_id string, certified boolean, probe_ok boolean, verified_on string, max_age_days int"
    row = trust_signals(engine.spark.createDataFrame([(term.id, term.certified, works, term.verified_on, term.max_age_days)], schema), reference_date).first()
    return {k: row[k] for k in ("evidence_tier", "drift", "status")}


#: What a claim may state.
CLAIM_FIELDS = ("period", "revenue_type", "refund_treatment", "reported_as", "recognition")


def context_query(engine, terms: Mapping[str, Term], name: str, reference_date: str, claim: Mapping[str, str | None] | None = None, tenant: str | None = None, industry: str | None = None, **request: Any) -> dict[str, Any]:
    """From a term to an answer: resolve, card, trust gate, claim gate, then the term's first metric.

    ``answer`` is one of ANSWERS. A term that isn't usable and a claim that contradicts itself are refused; an incomplete
    claim and a term without a metric ask back; caveats go with the answer.
    """
    term = resolve_term(terms, engine.kernel, name, tenant, industry)
    out: dict[str, Any] = {"term_id": term.id, "card": card(term, engine.kernel), "trust": trust_of(engine, term, reference_date)}
    if not term.metrics:
        return {**out, "answer": "clarify", "reason_code": "term_without_metric", "options": sorted(term.entities)}
    if out["trust"]["status"] == "not_usable":
        return {**out, "answer": "refuse", "reason_code": "term_not_usable"}
    if claim is not None:
        rows = engine.spark.createDataFrame([tuple(claim.get(k) for k in CLAIM_FIELDS)], ", ".join(f"{k} string" for k in CLAIM_FIELDS))
        found = validate_claims(rows).first()
        if found["outcome"] != "valid":
            return {**out, "answer": found["outcome"], "reason_code": "claim_" + ("refused" if found["outcome"] == "refuse" else "incomplete"), "violations": list(found["violations"])}
    made = engine.call("metric_query", term=term.metrics[0], tenant=tenant, industry=industry, reference_date=reference_date, **request)
    if made["status"] != "ok":
        return {**out, "answer": "clarify" if made["status"] == "clarify" else "refuse", **{k: v for k, v in made.items() if k not in ("status", "trace_id")}}
    caveats = [*made["caveats"], *([f"term_{out['trust']['status']}"] if out["trust"]["status"] != "trusted" else [])]
    return {**out, **{k: made[k] for k in ("rows", "metric_id", "answer_id", "plan_id")}, "caveats": caveats, "answer": "answer_with_caveats" if caveats else "answer"}
