"""Shared plumbing of the corpus operators: folder for cut lineage, ranks without one-task windows, components."""

from __future__ import annotations

import atexit
import re
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows that any operator here broadcasts; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: The same for rows of some hundred bytes, or where a table is broadcast again and again.
SMALL_ROWS = 20_000

_FALLBACK_DIR = "/tmp/tessera-checkpoints"
_written: set[str] = set()
_tables: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local one if executors run in
    this process, as in tests; on a cluster there is none that could do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (where or _FALLBACK_DIR).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by fresh_path()."""
    with suppress(Exception):  # a session that has ended can't delete; the folder's owner cleans up
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


@atexit.register
def _discard_all() -> None:
    spark = SparkSession.getActiveSession()
    for table in _tables if spark else ():
        with suppress(Exception):
            spark.sql(f"drop table if exists {table}")
    for path in list(_written) if spark else ():
        discard(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    The result has the attribute ``stored_at``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """df written like materialize() and bucketed by a column: grouping by it needs no shuffle of what is read.

    Table and files go when the session ends."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    _tables.add(table)
    df.write.format("parquet").bucketBy(buckets, column).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if ``rows``, its counted size, is within the bound; else as it is."""
    return F.broadcast(df) if rows <= most else df


def row_key(*cols: Column) -> Column:
    """64-bit hash of a row's columns in which nulls and empty strings differ: for order and dealing out, never the
    only key of a join."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def hash_share(df: DataFrame, h: Column, wanted: int, rows: int) -> DataFrame:
    """df's rows whose 64-bit hash h is so small that about ``wanted`` of its ``rows`` are left, and nearly never fewer
    than wanted (all, if there are fewer): a sample that doesn't depend on the layout, cut before it is sorted."""
    share = (1.3 * wanted + 100) / max(rows, 1)
    return df if share >= 1 else df.where(h <= F.lit(-(2**63) + int(2**64 * share)))


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and everything else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """df with ``rank``, the 0-based gapless position of each row in its group by ``order``.

    A window would put a whole group into one task. Here rows are range-partitioned by group and order, so that a
    large group spans many tasks, and written; each part's rows of a group get the group's count in earlier parts as
    offset. Only one row for each part and group is joined back. Rows that tie in every order column get distinct
    positions in an arbitrary but stored order.
    """
    mid, part = "__mid", "__part"
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = df.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    laid = materialize(laid.withColumn(mid, F.monotonically_increasing_id()), name)
    laid = laid.withColumn(part, F.shiftright(mid, 33))
    starts = laid.groupBy(*groups, part).agg(F.min(mid).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")))
    starts = starts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(part).alias("__p"), "__first", "__before")
    starts = materialize(starts, f"{name}-starts")
    on = F.col(part) == F.col("__p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = laid.join(maybe_broadcast(starts, starts.count()), on)
    return out.withColumn(rank, F.col(mid) - F.col("__first") + F.col("__before")).select(*df.columns, rank)


def small_parts(rows: int, spark: SparkSession) -> int:
    """Files for an intermediate table of so many narrow rows, at most the shuffle partitions."""
    return max(1, min(-(-rows // 200_000), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is the smallest node.

    Alternating large-star and small-star steps, each a partial-aggregated minimum and a join that Spark may split where
    a hub is skewed; every step's edges are written, so nothing is gathered on the driver. It ends when all edges point
    from a node to the root of a star.
    """
    spark = edges.sparkSession
    cur = materialize(edges.where("a <> b").select("a", "b").distinct(), name)
    n = cur.count()
    parts = small_parts(n, spark)
    crooked = n
    while crooked:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(maybe_broadcast(low, 2 * n, SMALL_ROWS), F.col("a") == F.col("u")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(maybe_broadcast(low, 2 * n, SMALL_ROWS), F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        old, cur = cur, materialize(small.select("x.a", "x.b").where("a <> b").distinct().coalesce(parts), name)
        discard(spark, old.stored_at)
        ends = cur.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x"))
        ends = ends.groupBy("x.v").agg(F.sum("x.out").alias("out"), F.max("x.into").alias("into"))
        crooked = ends.where("out > 1 or out = 1 and into = 1").count()
    out = cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x"))
    out = out.select("x.node", "x.component").distinct()
    out.stored_at = cur.stored_at
    return out
