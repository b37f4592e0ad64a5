"""Metric requests as DataFrames: one scan, the joins its dimensions need, one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import Clarify, Refusal
from tessera.functions.periods import bucket, period_range, within
from tessera.metrics import formula
from tessera.metrics.kernel import Kernel, Measure, Metric
from tessera.metrics.paths import guard_fan_out, join_path

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
MAX_ROWS = 100


@dataclass
class Compiled:
    df: DataFrame
    entity: str
    relations: list[str]
    filters: dict[str, Any]
    caveats: list[str] = field(default_factory=list)


def _measures(kernel: Kernel, m: Metric) -> list[Measure]:
    """Measures that a metric comes down to, in the order of reference."""
    if not m.derived:
        return [kernel.measures[m.measure]]
    out: list[Measure] = []
    for kind, ref in formula.references(m.formula):
        out += _measures(kernel, kernel.metrics[ref]) if kind == "metric" else [kernel.measures[ref]]
    return list(dict.fromkeys(out))


def _value(kernel: Kernel, m: Metric) -> Column:
    """The metric over the joined rows; nested metrics are put in place, and Catalyst computes equal aggregates once."""
    aggregate = lambda x: AGGREGATES[x.aggregation.replace("-", "_")](F.col(f"base.{x.field}"))
    if not m.derived:
        return aggregate(kernel.measures[m.measure])
    return formula.build(m.formula, lambda kind, ref: _value(kernel, kernel.metrics[ref]) if kind == "metric" else aggregate(kernel.measures[ref]))


def compile_metric(
    kernel: Kernel, table: Callable[[str], DataFrame], m: Metric, dimensions: Sequence[str] = (), filters: Mapping[str, Any] | None = None, grain: str | None = None,
    period: str | None = None, reference_date: str | None = None, strict: bool = False, max_rows: int = MAX_ROWS, name: str | None = None,
) -> Compiled:
    """The metric by dimensions and time bucket. ``table`` gives the DataFrame of a table.

    Filters are equalities on the metric's entity; the caller's replace those of a rule on the same column (a
    rule_override caveat says so; ``strict`` joins both by AND instead). Groups come in the order of their keys, so the
    limit of max_rows is stable. ``strict`` also widens the fan-out guard.
    """
    measures = _measures(kernel, m)
    entity = kernel.entities[measures[0].entity]
    if others := {x.entity for x in measures} - {entity.id}:
        raise Refusal("METRIC_SPANS_ENTITIES", ", ".join(sorted(others | {entity.id})))
    if bad := [d for d in dimensions if d not in m.dimensions]:
        raise Clarify("dimension_not_allowed", bad[0], sorted(m.dimensions))
    caveats: list[str] = []

    df = table(entity.table).alias("base")
    where: list[tuple[str, Any]] = [(c, v) for r in m.rules for c, v in kernel.rules[r].filters.items()]
    own = dict(filters or {})
    if any(c in own and own[c] != v for c, v in where):
        caveats.append("rule_override")
    where = [(c, v) for c, v in where if strict or c not in own] + list(own.items())
    for c, v in sorted(where, key=lambda x: x[0]):
        df = df.where(F.col(f"base.{c}") == F.lit(v))
    if period:
        if period not in kernel.periods:
            raise Clarify("unknown_period", period, list(kernel.periods))
        if not entity.time_field:
            raise Clarify("no_time_field", entity.id)
        df = df.where(within(F.col(f"base.{entity.time_field}"), *period_range(period, reference_date)))

    joined, relations = {entity.id: "base"}, []
    keys: list[Column] = []
    for target in sorted({kernel.dimensions[d].entity for d in dimensions}):
        path = join_path(kernel, entity.id, target)
        guard_fan_out(path, "sum" if m.derived else measures[0].aggregation, strict)
        for s in path:
            if s.there not in joined:
                joined[s.there] = f"e_{s.there}"
                other = table(kernel.entities[s.there].table).alias(joined[s.there])
                df = df.join(other, F.col(f"{joined[s.here]}.{s.here_key}") == F.col(f"{joined[s.there]}.{s.there_key}"), "inner")
                relations.append(s.relation)
    for d in dimensions:
        x = kernel.dimensions[d]
        keys.append(F.col(f"{joined[x.entity]}.{x.field}").alias(x.field))
    names = [kernel.dimensions[d].field for d in dimensions]
    if grain and grain not in kernel.grains:
        raise Clarify("unsupported_grain", grain, list(kernel.grains))
    if grain and entity.time_field:
        keys.append(bucket(F.col(f"base.{entity.time_field}"), grain).alias("time_bucket"))
        names.append("time_bucket")
    out = df.groupBy(*keys).agg(_value(kernel, m).alias(name or m.id))
    if names:
        out = out.orderBy(*[F.col(n).asc_nulls_last() for n in names])
    return Compiled(out.limit(max_rows), entity.id, relations, dict(where), caveats)
