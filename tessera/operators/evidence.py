"""Evidence closure: every claim rests on citations, every citation on provenance, every derived one on atoms.

Packets are tables, so the checks are joins: a dangling reference is a left anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure_issues(claims: DataFrame, citations: DataFrame, envelopes: DataFrame, contract_hash: str | None = None, packet: str | None = None) -> DataFrame:
    """(code, subject, detail) of everything that is open in a packet.

    claims (claim_id, evidence_ids array, source_ids array), citations (evidence_id, kind, source_id, provenance_id,
    supporting_evidence_ids array, may_support_claims), envelopes (provenance_id, source_id, contract_hash).

    The tables may hold many packets: `packet` names a column of all three that tells them apart, and comes first in
    the result. Ids then are looked up, and are unique, within their packet; nothing is found for rows that name none.
    """
    by = [packet] if packet else []

    def issue(df: DataFrame, code: Column | str, subject: str, detail: Column | str) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(*by, lit(code).alias("code"), F.col(subject).cast("string").alias("subject"), lit(detail).cast("string").alias("detail"))

    def many(df: DataFrame) -> DataFrame:
        """The looked-up side of a join. Tables of many packets are large; Spark takes computed ids for smaller than they are and would broadcast them."""
        return df.hint("merge") if packet else df

    used = claims.select(*by, "claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    cited = citations.select(*by, "evidence_id", F.col("source_id").alias("__have"), "may_support_claims", F.lit(True).alias("__found"))
    looked_up = used.where("evidence_id is not null").join(many(cited), [*by, "evidence_id"], "left")
    atoms = citations.where("kind = 'derived'").select(*by, F.col("evidence_id").alias("parent"), F.explode_outer("supporting_evidence_ids").alias("evidence_id"))
    traced = citations.where("provenance_id is not null").join(many(envelopes.select(*by, "provenance_id", F.col("source_id").alias("__s"), F.lit(True).alias("__found"))), [*by, "provenance_id"], "left")
    lost = F.col("__found").isNull()
    wanted = claims.select(*by, "claim_id", F.explode("source_ids").alias("wanted"))
    covered = looked_up.where(~lost).select(*[F.col(c).alias("__packet") for c in by], F.col("claim_id").alias("__claim"), "__have")
    meets = (F.col("claim_id") == F.col("__claim")) & ((F.col("__have") == F.col("wanted")) | F.col("wanted").startswith(F.concat(F.col("__have"), F.lit("."))))
    for c in by:
        meets = (F.col(c) == F.col("__packet")) & meets
    parts = [
        issue(claims.groupBy(*by, "claim_id").count().where("count > 1"), "duplicate_claim_id", "claim_id", ""),
        issue(used.where("evidence_id is null"), "claim_without_evidence", "claim_id", ""),
        issue(looked_up.where(lost | ~F.col("may_support_claims")), F.when(lost, "evidence_not_found").otherwise("evidence_not_claim_supporting"), "claim_id", F.col("evidence_id")),
        issue(citations.groupBy(*by, "evidence_id").count().where("count > 1"), "duplicate_evidence_id", "evidence_id", ""),
        issue(citations.where("kind not in ('atomic', 'derived') or kind is null"), "unknown_citation_kind", "evidence_id", F.col("kind")),
        issue(citations.where("kind = 'atomic' and provenance_id is null"), "provenance_missing", "evidence_id", ""),
        issue(traced.where((lost & (F.col("kind") == "atomic")) | (F.col("source_id") != F.col("__s"))), F.when(lost, "provenance_not_found").otherwise("source_mismatch"), "evidence_id", F.when(lost, F.col("provenance_id")).otherwise(F.col("__s"))),
        issue(atoms.where("evidence_id is null"), "derived_without_support", "parent", ""),
        issue(atoms.where("evidence_id is not null").join(many(citations.select(*by, "evidence_id")), [*by, "evidence_id"], "left_anti"), "supporting_evidence_not_found", "parent", F.col("evidence_id")),
        issue(wanted.join(many(covered), meets, "left_anti"), "source_not_covered", "claim_id", F.col("wanted")),
    ]
    if contract_hash is not None:
        parts.append(issue(envelopes.where(F.col("contract_hash") != contract_hash), "contract_hash_mismatch", "provenance_id", F.col("contract_hash")))
    return reduce(DataFrame.unionByName, parts)


#: Columns that a packet's tables must have, and those whose values may not be missing.
SHAPES = {
    "claims": ({"claim_id": "string", "evidence_ids": "array<string>", "source_ids": "array<string>"}, ("claim_id",)),
    "citations": ({"evidence_id": "string", "kind": "string", "source_id": "string", "provenance_id": "string", "supporting_evidence_ids": "array<string>", "may_support_claims": "boolean"}, ("evidence_id", "kind", "source_id")),
    "envelopes": ({"provenance_id": "string", "source_id": "string", "contract_hash": "string"}, ("provenance_id", "source_id", "contract_hash")),
}


def schema_issues(table: str, df: DataFrame) -> DataFrame:
    """(code, subject, detail, rows) of what is wrong with the form of one table of a packet: columns that are missing
    or have another type, and required columns in which rows have nothing. One pass over the rows."""
    columns, required = SHAPES[table]
    there = dict(df.dtypes)
    bad = [("column_missing", table, c, None) for c in columns if c not in there]
    bad += [("column_type", table, f"{c}: {there[c]}", None) for c, kind in columns.items() if c in there and there[c] != kind]
    out = df.sparkSession.createDataFrame(bad, "code string, subject string, detail string, rows long")
    tested = [c for c in required if c in there]
    if tested:
        counts = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in tested])
        each = counts.select(F.explode(F.array(*[F.struct(F.lit("value_missing").alias("code"), F.lit(table).alias("subject"), F.lit(c).alias("detail"), F.col(c).alias("rows")) for c in tested])).alias("x"))
        out = out.union(each.select("x.*").where("rows > 0"))
    return out


def missing_focus(request: dict) -> list[str]:
    """What an analysis request still has to state."""
    needs = {"metric": "metric_required", "time": "time_scope_required", "sources": "source_required", "relations": "relation_required", "decision": "decision_required", "capability": "capability_required"}
    several = len(request.get("sources") or ()) > 1
    return [code for key, code in needs.items() if not request.get(key) and (key != "relations" or several)]
