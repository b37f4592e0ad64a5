"""Edges of an exported data catalog, merged with the edges that terms declare; declared ones win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities of an export: the term that an entity describes, what it is related to, and its owner.
EXPORT = "urn string, glossaryTerm string, related array<string>, owner string"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Entities of an export: an object with a list of them, or the list itself."""
    whole = spark.read.schema(f"entities array<struct<{EXPORT.replace(' ', ':').replace(',:', ', ')}>>, {EXPORT}").option("multiLine", True).json(path)
    names = [c.split()[0] for c in EXPORT.split(", ")]
    own = F.array(F.struct(*names))
    return whole.select(F.explode(F.coalesce("entities", own)).alias("e")).select("e.*").where("glossaryTerm is not null or urn is not null")


def ingested(authored: DataFrame, entities: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, conflicts): authored edges (from_id, to_id, kind) with a ``catalog_related`` edge from each of ``terms``
    (term_id) to what the entities of its name are related to and to ``owner:`` and their owner; and (term_id, ref) that
    are authored already, in whatever kind, and stay as they are.

    Entities without a term, of an unknown term, or without relations and owner add nothing; repeated ones add once.
    """
    owner = F.when(F.col("owner") != "", F.array(F.concat(F.lit("owner:"), "owner")))
    refs = F.concat(F.coalesce("related", F.array().cast("array<string>")), F.coalesce(owner, F.array().cast("array<string>")))
    named = entities.join(terms.select(F.col("term_id").alias("glossaryTerm")).distinct(), "glossaryTerm", "left_semi")
    found = named.select(F.col("glossaryTerm").alias("from_id"), F.explode(refs).alias("to_id")).where("to_id is not null").distinct()
    there = authored.select("from_id", "to_id")
    new = found.join(there, ["from_id", "to_id"], "left_anti").select("from_id", "to_id", F.lit("catalog_related").alias("kind"))
    clashes = found.join(there, ["from_id", "to_id"], "left_semi").where("to_id not like 'owner:%'").select(F.col("from_id").alias("term_id"), F.col("to_id").alias("ref"))
    return authored.select("from_id", "to_id", "kind").union(new), clashes
