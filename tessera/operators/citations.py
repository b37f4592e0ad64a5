"""Citations: where each row of an answer comes from, as a column of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import content_id, row_id
from tessera.plans.contract import Contract


def provenance(contract: Contract, source_id: str, fields: Sequence[str], filters: Sequence[Mapping[str, Any]] = (), joins: Sequence[Mapping[str, str]] = (), may_support_claims: bool = True) -> dict[str, Any]:
    """Record of a query: what it read, under which rules and contract."""
    tables = {contract.field(f)["table"] for f in fields}
    rules = sorted({x["rule_id"] for t in tables for x in contract.exclusions(t)})
    body = {"source_id": source_id, "fields": sorted(fields), "filters": list(filters), "joins": list(joins), "rules_applied": rules, "contract_hash": contract.hash, "may_support_claims": may_support_claims}
    return {"provenance_id": content_id("prov:", body), **body}


def rule_impact(contract: Contract, tables: Sequence[str]) -> list[dict[str, Any]]:
    """Rules that changed what a query over the tables can see."""
    return [{k: x[k] for k in ("rule_id", "field_id", "operator", "value", "reason")} for t in tables for x in contract.exclusions(t)]


def cite(df: DataFrame, record: Mapping[str, Any], identity: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """df with ``_citation``: kind, evidence_id, source_id, provenance_id, record_ref, may_support_claims.

    record_ref names the row by its identity columns. Without any it is the row's number in the given order (default:
    all columns): answers are limited before they are cited, so the number needs no sort of a whole table.
    """
    if identity:
        ref = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(identity)]), {"ignoreNullFields": "false"})
    else:
        by = Window.orderBy(*[F.col(c).asc_nulls_last() for c in order or df.columns])
        ref = F.concat(F.lit('{"row_index":'), F.row_number().over(by) - 1, F.lit("}"))
    df = df.withColumn("__ref", ref)
    citation = F.struct(
        F.lit("atomic").alias("kind"), row_id("ev:", F.lit(record["source_id"]), F.col("__ref"), F.lit(record["provenance_id"])).alias("evidence_id"), F.lit(record["source_id"]).alias("source_id"),
        F.lit(record["provenance_id"]).alias("provenance_id"), F.col("__ref").alias("record_ref"), F.lit(bool(record["may_support_claims"])).alias("may_support_claims"),
    )
    return df.withColumn("_citation", citation).drop("__ref")
