"""Structured plans: {select, joins, filters, group_by, order_by, limit} over declared fields, as one DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.errors import Refusal
from tessera.plans.contract import Contract

#: Most rows that a source returns, and most values of an ``in`` list.
MAX_ROWS, MAX_IN = 100, 500
AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}
COMPARISONS = {
    "=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__,
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def clamp(limit: Any, most: int = MAX_ROWS, default: int | None = None) -> int:
    return max(1, min(int(limit if limit is not None else default or most), most))


def _refuse(detail: str) -> Refusal:
    return Refusal("plan_compile_failed", detail)


def predicate(c: Column, operator: str, value: Any) -> Column:
    if operator == "in":
        if not isinstance(value, (list, tuple)) or not value:
            raise _refuse("'in' needs a list with a value")
        if len(value) > MAX_IN:
            raise _refuse(f"'in' takes {MAX_IN} values at most")
        return c.isin(list(value))
    if operator not in COMPARISONS:
        raise _refuse(f"operator {operator!r}")
    return COMPARISONS[operator](c, F.lit(value))


def _joined(plan: Mapping[str, Any], contract: Contract, frames: dict[str, DataFrame], col) -> DataFrame:
    """All tables by inner joins on declared relations. Pairs between the same two tables make one condition."""
    wanted: dict[frozenset, list[tuple[str, str]]] = {}
    for j in plan.get("joins") or ():
        left, right = j.get("left"), j.get("right")
        tables = contract.field(left)["table"], contract.field(right)["table"]
        if not contract.related(left, right):
            raise _refuse(f"no relation {left} = {right}")
        if tables[0] != tables[1]:
            wanted.setdefault(frozenset(tables), []).append((left, right))
    first, *rest = sorted(frames)
    out, there, used = frames[first], {first}, set()
    while rest:
        step = next((pair for pair in wanted if len(pair & there) == 1 and pair <= set(frames)), None)
        if step is None:
            raise _refuse(f"tables not connected: {', '.join(rest)}")
        (new,) = step - there
        out = out.join(frames[new], reduce(Column.__and__, [col(a) == col(b) for a, b in wanted[step]]), "inner")
        there.add(new)
        used.add(step)
        rest.remove(new)
    # Relations that close a circle are conditions on the joined rows.
    for pair in wanted:
        if pair <= there and pair not in used:
            out = out.where(reduce(Column.__and__, [col(a) == col(b) for a, b in wanted[pair]]))
    return out


def compile_plan(spark: SparkSession, contract: Contract, plan: Mapping[str, Any]) -> DataFrame:
    """DataFrame of a plan. Exclusions apply unless apply_global_rules is exactly False; limit is 1 to 100.

    Rows come by order_by, and rows that tie, or all without it, by the selected columns from left to right."""
    contract.require_valid()
    select = list(plan.get("select") or ())
    if not select:
        raise _refuse("nothing selected")
    filters, group_by, order_by = list(plan.get("filters") or ()), list(plan.get("group_by") or ()), list(plan.get("order_by") or ())
    aliases = [s.get("alias") or contract.field(s["field"])["column"] for s in select]
    for a in aliases:
        if not _NAME.fullmatch(a):
            raise _refuse(f"alias {a!r}")
    if len(set(aliases)) < len(aliases):
        raise _refuse("two columns have one name")
    order_fields = [o["field"] for o in order_by if o["field"] not in aliases]
    ids = [*[s["field"] for s in select], *[f["field"] for f in filters], *group_by, *order_fields]
    ids += [j[s] for j in plan.get("joins") or () for s in ("left", "right")]
    tables = sorted({contract.field(i)["table"] for i in ids})
    if len({contract.field(i)["source"] for i in ids}) > 1:
        raise Refusal("single_query_spans_sources", ", ".join(sorted({contract.field(i)["source"] for i in ids})))
    rules = plan.get("apply_global_rules") is not False
    frames = {t: contract.table(spark, t, rules).alias(f"t_{k}") for k, t in enumerate(tables)}
    col = lambda i: F.col(f"t_{tables.index(contract.field(i)['table'])}.{contract.field(i)['column']}")

    df = _joined(plan, contract, frames, col)
    for f in filters:
        df = df.where(predicate(col(f["field"]), f.get("operator", "="), f.get("value")))

    made: list[Column] = []
    grouped = any(s.get("aggregation") for s in select)
    for s, a in zip(select, aliases, strict=True):
        kind = s.get("aggregation")
        if kind is not None and kind not in AGGREGATES:
            raise _refuse(f"aggregation {kind!r}")
        if not kind and (grouped or group_by) and s["field"] not in group_by:
            raise _refuse(f"{s['field']} is neither grouped nor aggregated")
        made.append((AGGREGATES[kind](col(s["field"])) if kind else col(s["field"])).alias(a))
    hidden = [f"__o{k}" for k in range(len(order_fields))]
    if grouped or group_by:
        keys = [col(g).alias(f"__g{k}") for k, g in enumerate(group_by)]
        if bad := [o for o in order_fields if o not in group_by]:
            raise _refuse(f"order by {bad[0]}, which is not grouped")
        parts = [m for m, s in zip(made, select, strict=True) if s.get("aggregation")]
        df = (df.groupBy(*keys) if keys else df).agg(*parts) if parts else df.select(*keys).distinct()
        at = {g: F.col(f"__g{k}") for k, g in enumerate(group_by)}
        df = df.select(*[F.col(a) if s.get("aggregation") else at[s["field"]].alias(a) for s, a in zip(select, aliases, strict=True)], *[at[o].alias(h) for o, h in zip(order_fields, hidden, strict=True)])
    else:
        df = df.select(*made, *[col(o).alias(h) for o, h in zip(order_fields, hidden, strict=True)])
    order = [_order(hidden[order_fields.index(o["field"])] if o["field"] in order_fields else o["field"], o.get("direction", "asc")) for o in order_by]
    order += ties(df, [a for a in aliases if a not in {o["field"] for o in order_by}])
    if order and (group_by or not grouped):
        df = df.orderBy(*order)
    return df.limit(clamp(plan.get("limit"))).select(*aliases)


def ties(df: DataFrame, columns: Iterable[str]) -> list[Column]:
    """Order by the columns that can be ordered: with it, a limit keeps the same rows in every run."""
    return [F.col(c).asc_nulls_last() for c in columns if not isinstance(df.schema[c].dataType, (MapType, VariantType))]


def _order(name: str, direction: str) -> Column:
    if direction not in ("asc", "desc"):
        raise _refuse(f"direction {direction!r}")
    return F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_last()
