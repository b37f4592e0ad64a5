"""From a business term to a metric."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.errors import Clarify
from tessera.metrics.kernel import Kernel, Metric


@dataclass(frozen=True)
class Resolution:
    metric: Metric
    caveats: tuple[str, ...]


def resolve(kernel: Kernel, term: str, tenant: str | None = None, industry: str | None = None, stale: frozenset[str] = frozenset()) -> Resolution:
    """An exact id (of any tenant), else the display name or a synonym, without case, in the collections that apply, by
    falling priority. Several in one collection, and none at all, ask back. ``stale``: metrics whose certification
    failed or is outdated."""
    if term in kernel.metrics:
        return _with_caveats(kernel, kernel.metrics[term], stale)
    applies = [c for c in kernel.collections.values() if c.tenant in (None, tenant) and c.industry in (None, industry)]
    for c in sorted(applies, key=lambda c: (-c.priority, c.id)):
        named = [m for m in kernel.metrics.values() if m.collection == c.id and term.casefold() in {m.name.casefold(), *(s.casefold() for s in m.synonyms)}]
        if len(named) > 1:
            raise Clarify("metric_ambiguous", term, sorted(m.id for m in named))
        if named:
            return _with_caveats(kernel, named[0], stale)
    raise Clarify("metric_unknown", term, sorted(kernel.metrics))


def _with_caveats(kernel: Kernel, m: Metric, stale: frozenset[str]) -> Resolution:
    out = []
    if kernel.collections[m.collection].priority < 100:
        out.append("fallback_metric")
    if m.status == "deprecated":
        out.append("deprecated_metric")
    if m.status == "uncertified" or m.id in stale:
        out.append("uncertified")
    return Resolution(m, tuple(out))
