"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w among weights that add up to 1, its j-th block (from 1) is released at
slot floor((j - 1) / w) and due by slot ceil(j / w). Each slot goes to the released block with the earliest deadline,
which meets every deadline, so at any time a source is less than one block from its share. When a source's share is used
up, the rest share its part in proportion to their weights: block j then ends at T(j / w), where T(v) is the sum over all
sources of min(w v, blocks). Releases and deadlines are floors and ceilings of T, reckoned in whole numbers from the
weights as they are given, so nothing is rounded over a run of any length.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, ranked, row_key

#: Documents of a block, parts of a period (of phases() only), exponent of a source's size in its default weight.
BLOCK, PARTS, POWER = 64, 1000, 0.7


def whole_parts(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole parts that add up to ``parts``, by largest remainder, at least one each."""
    total = sum(weights.values())
    parts = max(parts, 2 * len(weights))
    ideal = {k: w / total * (parts - len(weights)) for k, w in weights.items()}
    out = {k: 1 + int(x) for k, x in ideal.items()}
    for k in sorted(ideal, key=lambda k: (int(ideal[k]) - ideal[k], k))[: parts - sum(out.values())]:
        out[k] += 1
    return out


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first; ties by larger weight, then name."""
    length = sum(parts.values())
    slots: dict[str, list[int]] = {k: [] for k in parts}
    due = lambda k, j: (-(-j * length // parts[k]), -parts[k], k, j)
    waiting = [(0, k) for k in parts]  # (release, source) of each source's next block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in range(length):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, due(k, len(slots[k]) + 1))
        deadline, _, k, j = heapq.heappop(ready)
        assert t < deadline
        slots[k].append(t)
        if j < parts[k]:
            heapq.heappush(waiting, (j * length // parts[k], k))
    return slots


def phases(parts: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """(source, first block, end, first slot, parts, period's length, slots in a period) for each phase of each source.

    For weights that are whole parts of a short period; schedule() agrees with it as long as
    deadlines come before the first share is used up. Mixing doesn't use it.
    """
    left, begun, base, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {k: parts[k] for k in left}
        common = math.gcd(*own.values())
        own = {k: a // common for k, a in own.items()}
        length, slots = sum(own.values()), period(own)
        until = 1 + min((n - 1) // own[k] * length + slots[k][(n - 1) % own[k]] for k, n in left.items())
        for k in sorted(left):
            got = until // length * own[k] + sum(s < until % length for s in slots[k])
            got = min(got, left[k])
            out.append((k, begun[k], begun[k] + got, base, own[k], length, slots[k]))
            begun[k], left[k] = begun[k] + got, left[k] - got
        left = {k: n for k, n in left.items() if n}
        base += until
    return out


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block from 0, slot) of every block, by slot; ties of deadlines by larger weight, then name.

    Weights count as exactly the numbers that they are. Sources of weight 0 follow all others, in equal parts. Memory is
    in proportion to the number of sources, not of blocks.
    """
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    exact = {k: Fraction(weights[k]) for k, n in blocks.items() if n and weights[k]}
    whole = math.lcm(*[w.denominator for w in exact.values()])
    w = {k: int(x * whole) for k, x in exact.items()}
    ended = sorted(w, key=lambda k: (Fraction(blocks[k], w[k]), k))  # by the time at which shares are used up
    size, weight = [blocks[k] for k in ended], [w[k] for k in ended]
    served, rest = [0], [sum(weight)]
    for n, x in zip(size, weight, strict=True):
        served.append(served[-1] + n)
        rest.append(rest[-1] - x)

    def window(k: str, j: int, low: int) -> tuple[int, int, int]:
        """Floor and ceiling of T(j / w[k]), and how many sources have ended before, at least ``low``."""
        high = len(size)
        while low < high:
            mid = (low + high) // 2
            if size[mid] * w[k] < j * weight[mid]:
                low = mid + 1
            else:
                high = mid
        return served[low] + j * rest[low] // w[k], served[low] - (-j * rest[low] // w[k]), low

    waiting = [(0, k, 1, 0) for k in w]  # (release, source, number, sources that ended before) of each next block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in range(served[-1]):
        while waiting and waiting[0][0] <= t:
            _, k, j, low = heapq.heappop(waiting)
            release, due, low = window(k, j, low)
            heapq.heappush(ready, (due, -w[k], k, j, release, low))
        due, _, k, j, release, low = heapq.heappop(ready)
        assert t < due
        yield k, j - 1, t
        if j < blocks[k]:
            heapq.heappush(waiting, (release, k, j + 1, low))
    if late := {k: n for k, n in blocks.items() if n and not weights[k]}:
        yield from ((k, b, t + served[-1]) for k, b, t in schedule(dict.fromkeys(late, 1.0), late))


def _planned(given: dict[str, float], block: int):
    """Rows (source, block, slot) of the schedule for rows (source, number of its rows), all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {k: n for x in batches for k, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
        weights = {k: given.get(k, min(given.values())) if given else n**POWER for k, n in sizes.items()}
        held = []
        for row in schedule(weights, {k: -(-n // block) for k, n in sizes.items()}):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["__s", "__b", "mix_slot"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["__s", "__b", "mix_slot"])

    return run


def mix_sources(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """df with ``mix_block`` (of its source, from 0), ``mix_slot`` and ``mix_position``, by which the mixture is ordered.

    ``weights`` are by source (sources left out get the smallest weight given); by default a source's weight is its
    number of rows to the power 0.7. Every source is scheduled on its own, however many there are. Every row has a position, none is dropped or repeated. After any number of slots a source has
    less than one block more or less than its share by its exact weight; what sources whose share is used up leave goes
    to the rest in proportion to their weights. Within a source rows follow a hash of id and text. Positions have gaps
    where a last block isn't full. Weights that are negative or not finite are an error; sources of weight 0 come last.

    Null sources form a source of their own. Rows with null ids or texts and repeated rows are mixed like others. An
    empty df gives an empty result. Columns with the three names are replaced; others stay. The schedule has a row for
    each block: one task makes it and writes it, holding the sources only; it is joined by source and block.
    """
    spark = df.sparkSession
    df = df.drop("mix_block", "mix_slot", "mix_position")
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    given = {f"={k}": w for k, w in weights.items()} if weights else {}
    if not all(math.isfinite(w) and w >= 0 for w in given.values()):
        raise ValueError("weights must be finite and not negative")
    keyed = df.withColumn("__s0", name)
    sizes = keyed.groupBy("__s0").count().repartition(1)
    table = materialize(sizes.mapInArrow(_planned(given, block), "__s string, __b long, mix_slot long"), "mix-plan")
    slots = table.count()
    if not slots:
        return df.withColumns({c: F.lit(None).cast("long") for c in ("mix_block", "mix_slot", "mix_position")})
    keyed = keyed.withColumn("__h", row_key(F.col(id_col), F.xxhash64(text_col)))
    laid = ranked(keyed, ["__s0"], ["__h"], "__rank", "mix").withColumn("mix_block", F.floor(F.col("__rank") / block))
    out = laid.join(maybe_broadcast(table, slots), (F.col("__s0") == F.col("__s")) & (F.col("mix_block") == F.col("__b")))
    out = out.withColumn("mix_position", F.col("mix_slot") * block + F.col("__rank") % block)
    return out.select(*df.columns, "mix_block", "mix_slot", "mix_position")


def mixed(df: DataFrame, source_col: str = "source", **options) -> DataFrame:
    """df in the order of the mixture: written in order, its files read one after the other give the mixture."""
    out = mix_sources(df, source_col, **options)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return out.repartitionByRange(n, "mix_position").sortWithinPartitions("mix_position").select(df.columns)


def op9_pfair_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # Only the hash of the text is needed: texts don't travel.
    docs = docs.select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))
    return mix_sources(docs).drop("text")
