"""Lineage of metrics as an edge DataFrame, and closures over it as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.metrics import formula
from tessera.metrics.kernel import Kernel


def edges(spark: SparkSession, kernel: Kernel) -> DataFrame:
    """(from_id, to_id, kind): uses_measure, uses_metric, reads_column, allows_dimension, of_entity."""
    rows = []
    for m in kernel.metrics.values():
        refs = formula.references(m.formula) if m.derived else [("measure", m.measure)]
        rows += [(f"metric:{m.id}", f"{kind}:{ref}", f"uses_{kind}") for kind, ref in refs]
        rows += [(f"metric:{m.id}", f"dimension:{d}", "allows_dimension") for d in m.dimensions]
    for kind, items in (("measure", kernel.measures), ("dimension", kernel.dimensions)):
        for x in items.values():
            e = kernel.entities[x.entity]
            rows += [(f"{kind}:{x.id}", f"column:{e.source}.{e.table}.{x.field}", "reads_column"), (f"{kind}:{x.id}", f"entity:{e.id}", "of_entity")]
    for r in kernel.relations.values():
        rows += [(f"entity:{a}", f"relation:{r.id}", "has_relation") for a in dict.fromkeys((r.left, r.right))]
    return spark.createDataFrame(rows, "from_id string, to_id string, kind string")


def closure(graph: DataFrame, starts: list[str]) -> DataFrame:
    """Edges that can be reached from the starts. One join for each step of the graph's depth, which the kernel bounds."""
    found = reached = graph.sparkSession.createDataFrame([(s,) for s in starts], "id string")
    while True:
        found = graph.join(found, graph.from_id == found.id, "left_semi").select(F.col("to_id").alias("id")).distinct().join(reached, "id", "left_anti")
        if not found.take(1):
            return graph.join(reached, graph.from_id == reached.id, "left_semi")
        reached = reached.union(found).distinct()
