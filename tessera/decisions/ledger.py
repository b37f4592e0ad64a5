"""Ledger: an append-only table of artifacts. Ids are hashes of content, so an event that is written twice is one event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import canonical, content_id

SCHEMA = "artifact_id string, artifact_type string, source_id string, evidence_tier string, recorded_at timestamp, contract_hash string, payload string, lineage_edges array<struct<from_id:string,to_id:string,kind:string>>"


def artifact_id(kind: str, source_id: str, payload: Mapping[str, Any], edges: Sequence[Sequence[str]] = ()) -> str:
    return content_id("art-", {"type": kind, "source": source_id, "payload": payload, "edges": [list(e) for e in edges]})


class Ledger:
    """Artifacts under a path that the cluster shares. Writers append files and never change one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: Sequence[Mapping[str, Any]]) -> list[str]:
        """Append events {artifact_type, source_id, payload, edges, evidence_tier, recorded_at, contract_hash}; their ids."""
        rows = []
        for e in events:
            edges = [tuple(x) for x in e.get("edges", ())]
            rows.append((artifact_id(e["artifact_type"], e["source_id"], e["payload"], edges), e["artifact_type"], e["source_id"], e.get("evidence_tier"), e["recorded_at"], e.get("contract_hash"), canonical(e["payload"]), edges))
        self.spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(self.path)
        return [r[0] for r in rows]

    def all(self) -> DataFrame:
        """Events, each id once with its latest record."""
        df = self.spark.read.schema(SCHEMA).parquet(self.path)
        newest = Window.partitionBy("artifact_id").orderBy(F.desc("recorded_at"), F.desc("contract_hash"))
        return df.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")

    def get(self, artifact: str) -> dict[str, Any] | None:
        row = self.all().where(F.col("artifact_id") == artifact).first()
        return row.asDict(recursive=True) if row else None

    def expired(self, contract_hash: str) -> DataFrame:
        """Artifacts of another contract than the current one."""
        return self.all().where(~F.col("contract_hash").eqNullSafe(F.lit(contract_hash)))

    def lineage(self) -> DataFrame:
        return self.all().select("artifact_id", F.explode("lineage_edges").alias("e")).select("artifact_id", "e.*")
