"""Document queries: filters by operator over declared fields; a missing field is unequal to everything."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.errors import Refusal
from tessera.plans.contract import Contract
from tessera.plans.roles import columns_with
from tessera.plans.semantic_plan import clamp, ties

OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "exists")


def column_of(contract: Contract, table: str, key: str) -> str:
    """The column of a field id or bare name; operators as keys are not read-only."""
    if key.startswith("$"):
        raise Refusal("not_read_only", key)
    columns = contract.data["tables"][table]["columns"]
    name = key.rpartition(".")[2] if key in columns.values() else key
    if name not in columns:
        raise Refusal("field_not_allowed", key)
    return name


def clause(c: Column, operator: str, value: Any, array: bool = False) -> Column:
    """One condition. On arrays eq and in ask for an element; ne and nin keep rows where the field is missing."""
    if operator not in OPERATORS:
        raise Refusal("operator_not_allowed", operator)
    if operator in ("in", "nin"):
        values = [F.lit(v) for v in value]
        there = F.arrays_overlap(c, F.array(*values)) if array and values else c.isin(list(value)) if values else F.lit(False)
        return there if operator == "in" else ~F.coalesce(there, F.lit(False))
    if operator == "exists":
        return c.isNotNull() if value else c.isNull()
    if operator in ("eq", "ne"):
        there = F.array_contains(c, value) if array and not isinstance(value, (list, tuple)) else c.eqNullSafe(F.lit(value))
        return there if operator == "eq" else ~F.coalesce(there, F.lit(False))
    return {"gt": c > F.lit(value), "gte": c >= F.lit(value), "lt": c < F.lit(value), "lte": c <= F.lit(value)}[operator]


def query_documents(
    spark: SparkSession, contract: Contract, table: str, filters: Mapping[str, Any] | None = None, projection: Sequence[str] | None = None, sort: Sequence[Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows that meet every clause and no exclusion. ``filters``: key -> value or {operator: value, ...}.

    Each clause is a condition of its own, so none can replace an exclusion. Ascending sorts put missing values first.
    Rows that tie, or all without a sort, come by the table's identity and then its other columns.
    """
    contract.require_valid()
    if table not in contract.data["tables"]:
        raise Refusal("table_not_allowed", table)
    df = contract.table(spark, table, keep_missing=True)
    arrays = {f.name for f in df.schema if isinstance(f.dataType, ArrayType)}
    for key, spec in (filters or {}).items():
        name = column_of(contract, table, key)
        for op, value in spec.items() if isinstance(spec, Mapping) else (("eq", spec),):
            df = df.where(clause(F.col(name), op.removeprefix("$"), value, name in arrays))
    order, named = [], columns_with(contract.data, table, "identity")
    for s in sort or ():
        key, direction = (s, 1) if isinstance(s, str) else s
        if direction not in (1, -1):
            raise Refusal("operator_not_allowed", f"sort direction {direction}")
        c = F.col(column_of(contract, table, key))
        order.append(c.asc_nulls_first() if direction == 1 else c.desc_nulls_last())
    df = df.orderBy(*order, *ties(df, [*named, *[c for c in df.columns if c not in named]]))
    if projection:
        df = df.select(*dict.fromkeys(column_of(contract, table, p) for p in projection))
    return df.limit(clamp(limit))
