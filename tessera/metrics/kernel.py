"""The kernel: entities, measures, dimensions, relations, rules, time spine and metrics, loaded from plain mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from tessera.errors import Issue, Refusal
from tessera.functions.hashing import digest
from tessera.functions.periods import GRAINS, PERIODS
from tessera.metrics import formula

AGGREGATIONS = ("sum", "count", "avg", "min", "max", "count_distinct")
CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many", "many_to_many")
STATUSES = ("draft", "certified", "deprecated", "uncertified")


@dataclass(frozen=True)
class Entity:
    id: str
    source: str
    table: str
    primary_key: str
    time_field: str | None = None


@dataclass(frozen=True)
class Measure:
    id: str
    entity: str
    field: str
    aggregation: str


@dataclass(frozen=True)
class Dimension:
    id: str
    entity: str
    field: str
    type: str = "categorical"


@dataclass(frozen=True)
class Relation:
    """A join of two entities; the keys' names may differ."""

    id: str
    left: str
    right: str
    left_key: str
    right_key: str
    cardinality: str = "many_to_one"


@dataclass(frozen=True)
class Rule:
    id: str
    filters: Mapping[str, Any]


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    collection: str
    measure: str | None = None
    formula: str | None = None
    rules: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    grain: str = "row"
    status: str = "certified"
    max_age_days: int | None = None
    sla: str = "soft"

    @property
    def derived(self) -> bool:
        return self.formula is not None

    @property
    def definition_hash(self) -> str:
        return digest({"kind": "derived" if self.derived else "measure", "measure": self.measure, "formula": self.formula, "grain": self.grain, "rules": sorted(self.rules), "dimensions": sorted(self.dimensions)})


@dataclass(frozen=True)
class Collection:
    """Metrics of a tenant, an industry or everyone; higher priority wins."""

    id: str
    priority: int
    tenant: str | None = None
    industry: str | None = None


@dataclass(frozen=True)
class Kernel:
    collections: dict[str, Collection]
    entities: dict[str, Entity]
    measures: dict[str, Measure]
    dimensions: dict[str, Dimension]
    relations: dict[str, Relation]
    rules: dict[str, Rule]
    metrics: dict[str, Metric]
    grains: tuple[str, ...] = GRAINS
    periods: tuple[str, ...] = PERIODS
    source_max_age_days: int | None = None
    issues: tuple[Issue, ...] = field(default=())

    @property
    def hash(self) -> str:
        return digest({s: {k: str(v) for k, v in getattr(self, s).items()} for s in _KINDS})


_KINDS = {"collections": Collection, "entities": Entity, "measures": Measure, "dimensions": Dimension, "relations": Relation, "rules": Rule, "metrics": Metric}


def load(raw: Mapping[str, Any]) -> Kernel:
    """The kernel of a mapping {section: {id: settings}}. Unknown settings, references and cycles are refused."""
    made: dict[str, dict[str, Any]] = {}
    for section, kind in _KINDS.items():
        known = {f.name for f in fields(kind)}
        made[section] = {}
        for k, settings in (raw.get(section) or {}).items():
            if extra := sorted(set(settings) - known):
                raise Refusal("KERNEL_INVALID", f"{section}.{k}: unknown {', '.join(extra)}")
            made[section][k] = kind(id=k, **{x: tuple(v) if isinstance(v, list) else v for x, v in settings.items()})
    kernel = Kernel(**made, **{k: tuple(raw[k]) for k in ("grains", "periods") if k in raw}, source_max_age_days=raw.get("source_max_age_days"))
    if problems := list(check(kernel)):
        raise Refusal("KERNEL_INVALID", "; ".join(f"{p.where}: {p.detail}" for p in problems), issues=[p.code for p in problems])
    return kernel


def check(k: Kernel) -> Iterable[Issue]:
    def known(section: str, name: str | None, where: str) -> Iterable[Issue]:
        if name not in getattr(k, section):
            yield Issue("unknown_reference", where, f"{section} has no {name}")

    for m in k.measures.values():
        yield from known("entities", m.entity, f"measures.{m.id}")
        if m.aggregation.replace("-", "_") not in AGGREGATIONS:
            yield Issue("unknown_aggregation", f"measures.{m.id}", m.aggregation)
    for d in k.dimensions.values():
        yield from known("entities", d.entity, f"dimensions.{d.id}")
    for r in k.relations.values():
        for side in (r.left, r.right):
            yield from known("entities", side, f"relations.{r.id}")
        if r.cardinality not in CARDINALITIES:
            yield Issue("unknown_cardinality", f"relations.{r.id}", r.cardinality)
    for m in k.metrics.values():
        at = f"metrics.{m.id}"
        yield from known("collections", m.collection, at)
        for x in m.rules:
            yield from known("rules", x, at)
        for x in m.dimensions:
            yield from known("dimensions", x, at)
        if m.status not in STATUSES:
            yield Issue("unknown_status", at, m.status)
        if (m.measure is None) == (m.formula is None):
            yield Issue("metric_kind", at, "needs either a measure or a formula")
            continue
        if not m.derived:
            yield from known("measures", m.measure, at)
            continue
        try:
            formula.check(m.formula)
        except Refusal as e:
            yield Issue("formula_invalid", at, e.detail)
            continue
        for kind, ref in formula.references(m.formula):
            bad = list(known("metrics" if kind == "metric" else "measures", ref, at))
            yield from bad
            if not bad and kind == "metric" and k.metrics[ref].grain != m.grain:
                yield Issue("grain_mismatch", at, f"{ref} has grain {k.metrics[ref].grain}")
    yield from _cycles(k)


def _cycles(k: Kernel) -> Iterable[Issue]:
    state: dict[str, int] = {}

    def visit(m: str) -> bool:
        if state.get(m) == 1:
            return True
        if m in state or m not in k.metrics:
            return False
        state[m] = 1
        found = any(kind == "metric" and visit(ref) for kind, ref in formula.references(k.metrics[m].formula or ""))
        state[m] = 2
        return found

    for m in k.metrics:
        if visit(m):
            yield Issue("metric_cycle", f"metrics.{m}", "metrics refer to each other in a circle")
            return
