"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until leaves fit.

The driver holds the tree alone. A cut is found by histograms: one aggregation over all rows gives, for every open node
at once, the bytes in the bins of the bracket that still holds its cut, and the bracket, at first from the smallest to
the largest value of the node, shrinks to the bin in which the cut lies. Rows find their nodes by the cuts so far, in
joins with the tables of cuts, and are written anew only every REWRITE levels. Rows are ordered by the dimension, then by a hash of the text and then by id, so ties are cut as finely as
needed: a cut stays at an edge of a group of equal texts if one is near, and goes through the group, by id, only where
the group is large against a shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast, ranked, row_key

#: Bins of one node's histogram at most, and of all open nodes' together, which the driver receives.
BINS, ALL_BINS = 4096, 100_000
#: Levels of the tree after which rows are written with their nodes.
REWRITE = 6
#: Errors of a cut that are put up with, as shares of a leaf's bytes: anywhere, and to keep a group of copies whole.
TOLERANCE, COPIES = 0.001, 0.02
_LO, _HI = -(2**63), 2**63 - 1


@dataclass
class _Node:
    """A subtree of ``leaves`` leaves from number ``first`` on, and its cut in the making.

    Keys have three parts: dimension, text hash, id. The parts before ``len(fixed)`` equal ``fixed``, and the next one
    lies in lo..hi; ``before`` bytes lie lower. Rows whose key is below ``cut``, part by part, go left.
    """

    first: int
    leaves: int
    total: int = 0
    dim: int = 0
    fixed: tuple = ()
    lo: int = _LO
    hi: int = _HI
    before: int = 0
    cut: tuple | None = None

    def narrow(self, bins: list[tuple[int, int, int]], leaf: float) -> None:
        """Shrink the bracket, or fix the cut. bins: bytes, smallest and largest value of each, in order."""
        goal, at = self.total * (self.leaves // 2) / self.leaves, self.before
        if not bins:
            self.cut = (*self.fixed, self.lo)
            return
        for k, (size, lo, hi) in enumerate(bins):
            if at + size >= goal or k == len(bins) - 1:
                break
            at += size
        near = min(goal - at, at + size - goal)
        single, level = lo == hi, len(self.fixed)
        if near <= leaf * (COPIES if single and level == 1 else TOLERANCE) or single and level == 2:
            self.cut = (*self.fixed, lo if goal - at <= at + size - goal else min(hi + 1, _HI))
        elif single:
            self.fixed, self.lo, self.hi, self.before = (*self.fixed, lo), _LO, _HI, at
        else:
            self.lo, self.hi, self.before = lo, hi, at


def _find_cuts(rows: DataFrame, dims: list[str], nodes: list[_Node], leaf: float) -> None:
    spark = rows.sparkSession
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    while open_ := [n for n in nodes if n.cut is None]:
        bins = max(4, min(BINS, ALL_BINS // len(open_)))
        spec = [(n.first, n.dim, len(n.fixed), *(*n.fixed, 0, 0)[:2], n.lo, n.hi, str((n.hi - n.lo) // bins + 1)) for n in open_]
        spec = spark.createDataFrame(spec, "__n int, dim int, level int, f0 long, f1 long, lo long, hi long, width string").withColumn("width", F.col("width").cast("decimal(20,0)"))
        here = rows.join(maybe_broadcast(spec, len(open_)), F.col("__node") == F.col("__n")).withColumn("__k0", value)
        here = here.where("(level < 1 or __k0 = f0) and (level < 2 or __k1 = f1)")
        here = here.withColumn("part", F.expr("case level when 0 then __k0 when 1 then __k1 else __k2 end")).where("part between lo and hi")
        number = F.floor((F.col("part").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("width")).cast("int")
        got = here.groupBy("__n", number.alias("bin")).agg(F.sum("__size").alias("bytes"), F.min("part").alias("least"), F.max("part").alias("most")).collect()
        by: dict[int, list] = {}
        for r in sorted(got, key=lambda r: r["bin"]):
            by.setdefault(r["__n"], []).append((r["bytes"], r["least"], r["most"]))
        for n in open_:
            n.narrow(by.get(n.first, []), leaf)


def _ordinal(df: DataFrame, name: str) -> Column:
    """An integer id as it is, any other one by hash; null is smallest."""
    whole = dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(name).cast("long") if whole else F.when(F.col(name).isNotNull(), row_key(F.col(name))), F.lit(_LO))


def kd_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for each row of df.

    size is the text's UTF-8 bytes (none for null) plus 8. The tree has ``shards`` leaves, or as many as leave each
    about ``target_bytes``; a node of n leaves is cut at n // 2 : n - n // 2 of its bytes along the dimension whose
    range in the node is the largest share of its range in df. So shards have nearly equal bytes. ``dims`` are integer
    metadata (default: the text's bytes, lines, and bytes beyond one a character, which are the same for equal texts).
    Equal texts then stay together where that costs little; a group of copies that is large against a shard is cut by id. slot is the
    position in the shard, gapless from 0, by text hash and id; it is found without a one-task window.

    Nulls in a dimension count as its smallest value, null ids as smallest ids. Repeated rows get a slot each. Empty and
    null texts have size 8. An empty df gives an empty result. Other columns of df are ignored, whatever their names.
    """
    assert (target_bytes is None) != (shards is None)
    spark, text = df.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if dims is None:
        dims = {"bytes": F.octet_length(text), "wide": F.octet_length(text) - F.length(text), "lines": F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))}
    names = [f"__d{k}" for k in range(len(dims))]
    rows = df.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 8).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"), F.lit(0).alias("__node"),
        F.xxhash64(text).alias("__k1"), _ordinal(df, id_col).alias("__k2"), *[F.coalesce(c.cast("long"), F.lit(_LO)).alias(n) for n, c in zip(names, dims.values(), strict=True)],
    )
    rows = stored = materialize(rows, "kd-rows")
    measures = [F.sum("__size").alias("total"), *[f(n).alias(f"{s}{n}") for n in names for s, f in (("lo", F.min), ("hi", F.max))]]
    whole = rows.agg(*measures).first()
    total = whole["total"] or 0
    nodes = [_Node(0, shards or max(1, math.ceil(total / target_bytes)))]
    leaf, level = total / nodes[0].leaves, 0
    while live := [n for n in nodes if n.leaves > 1 and total]:
        by_first = {n.first: n for n in live}
        for r in rows.groupBy("__node").agg(*measures).collect():
            if n := by_first.get(r["__node"]):
                spread = [(r[f"hi{d}"] - r[f"lo{d}"]) / max(1, whole[f"hi{d}"] - whole[f"lo{d}"]) for d in names]
                n.total, n.dim = r["total"], spread.index(max(spread))
                n.lo, n.hi = r[f"lo{names[n.dim]}"], r[f"hi{names[n.dim]}"]
        _find_cuts(rows, names, live, leaf)
        cuts = spark.createDataFrame([(n.first, n.dim, *(*n.cut, None, None)[:3], n.first + n.leaves // 2) for n in live], "__n int, dim int, c0 long, c1 long, c2 long, right int")
        there = rows.join(maybe_broadcast(cuts, len(live)), F.col("__node") == F.col("__n"), "left").withColumn("__k0", F.element_at(F.array(*names), F.col("dim") + 1))
        left = F.expr("__k0 < c0 or coalesce(__k0 = c0 and __k1 < c1, false) or coalesce(__k0 = c0 and __k1 = c1 and __k2 < c2, false)")
        rows = there.withColumn("__node", F.when(F.col("right").isNull() | left, F.col("__node")).otherwise(F.col("right"))).select(rows.columns)
        level += 1
        if level % REWRITE == 0:
            stored, old = materialize(rows, "kd-rows"), stored
            rows = stored
            discard(spark, old.stored_at)
        nodes = [n for n in nodes if n.leaves <= 1] + [x for n in live for x in (_Node(n.first, n.leaves // 2), _Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2))]
    out = ranked(rows.select("__id", "__size", "__crc", "__k1", "__k2", F.col("__node").alias("__shard")), ["__shard"], ["__k1", "__k2"], "__slot", "kd-slots")
    discard(spark, stored.stored_at)  # ranked() has written its rows
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def op1_kd_shards(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
