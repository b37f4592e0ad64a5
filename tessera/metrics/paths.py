"""Join paths between entities, and the guard against counting rows twice."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.errors import Refusal
from tessera.metrics.kernel import Kernel

_REVERSED = {"many_to_one": "one_to_many", "one_to_many": "many_to_one"}


@dataclass(frozen=True)
class Step:
    """One join, walked from entity ``here`` to entity ``there``."""

    relation: str
    here: str
    there: str
    here_key: str
    there_key: str
    cardinality: str


def _steps(kernel: Kernel, entity: str) -> list[Step]:
    out = []
    for r in kernel.relations.values():
        if r.left == entity:
            out.append(Step(r.id, r.left, r.right, r.left_key, r.right_key, r.cardinality))
        if r.right == entity:
            out.append(Step(r.id, r.right, r.left, r.right_key, r.left_key, _REVERSED.get(r.cardinality, r.cardinality)))
    return out


def join_path(kernel: Kernel, start: str, goal: str) -> tuple[Step, ...]:
    """A shortest path; of several the one whose relation ids come first."""
    level: dict[str, tuple[Step, ...]] = {start: ()}
    seen = {start}
    while level:
        if goal in level:
            return level[goal]
        found: dict[str, list[tuple[Step, ...]]] = {}
        for entity, path in level.items():
            for step in _steps(kernel, entity):
                if step.there not in seen:
                    found.setdefault(step.there, []).append((*path, step))
        level = {e: min(paths, key=lambda p: tuple(s.relation for s in p)) for e, paths in found.items()}
        seen |= set(level)
    raise Refusal("METRIC_NO_JOIN_PATH", f"{start} to {goal}")


def guard_fan_out(path: tuple[Step, ...], aggregation: str, strict: bool = False) -> None:
    """Refuse sums over joins that repeat rows; ``strict`` refuses many-to-many joins and other aggregates too."""
    for s in path:
        repeats = s.cardinality == "one_to_many" or strict and s.cardinality == "many_to_many"
        if repeats and (aggregation == "sum" or strict and aggregation in ("count", "avg")):
            raise Refusal("METRIC_FANOUT_BLOCKED", f"{aggregation} over {s.relation} ({s.cardinality})")
