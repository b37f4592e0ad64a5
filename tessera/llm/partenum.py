"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands. Within a band two sets that are similar enough differ in at most k elements.
The shingle domain is cut into first-level partitions, each into second-level cells, and a set has one signature for
each subset of cells of a first-level partition that leaves out as many cells as may differ there. By the pigeonhole
principle similar sets share a signature, so candidates are found by equality alone; an exact check follows.

A partition counts for a set if every subset of its cells holds one of the set's elements; signatures of empty cells
would be shared by all. A set needs k // (misses + 1) + 1 partitions that count, k being the most elements in which it
can differ from any partner in the band, and takes them in the order of their numbers, with all partitions on the way.
Of two similar sets, the one that ends first has enough in what both have taken: each partition that does not agree in
some subset holds at least misses + 1 of the differing elements. A set that runs out of partitions takes all of them
and is cut anew by another hash family, so that two sets which both run out meet there; in the last family it has the
signatures of empty cells too. No pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import BROADCAST_ROWS, components, discard, materialize, maybe_broadcast

#: Ratio of the bands' ends, second-level cells of a partition, and how many of them may differ.
BAND, CELLS, MISSES = 2.0, 2, 1
#: Partitions of a band over those that its largest sets need, as a factor: some are empty for some sets.
SPARE = 1.1
#: Hash families tried for sets with many empty cells.
FAMILIES = 6
#: Sets, and bytes of their texts, that one task compares with each other.
BLOCK_NODES, BLOCK_BYTES = 2048, 16 << 20
#: Most sets that an element may be in to be counted pair by pair, and columns of a matrix of the others.
RARE, MATRIX = 32, 4096
#: Least and most cells of a set's sketch as powers of two, and shares of the allowed difference by which sketches that
#: are likely to mean a link are told from others.
SKETCH_BITS, LIKELY = (5, 10), (0.3, 0.6, 1.0)
#: Pairs for each node of a signature, on average, that are laid out; beyond it whole blocks are compared.
PAIRS = 32
#: Of the sample that finds signatures shared by very many texts: one text in so many, texts at most, and how many of
#: them must share a signature.
HOT_EVERY, HOT_SAMPLE, HOT_COUNT = 64, 50_000, 16
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19


class Bands:
    """Size bands and their partitionings for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int, ratio: float = BAND, cells: int = CELLS, misses: int = MISSES):
        assert 50 <= percent <= 100 and ratio * percent > 100 and 0 <= misses < cells
        self.percent, self.cells, self.misses = percent, cells, misses
        self.ratio, self.ends = ratio, [1]
        self.subsets = list(combinations(range(cells), cells - misses))

    def band(self, size: int) -> int:
        """The band that holds a set of this size: ends[i - 1] < size <= ends[i]."""
        while self.ends[-1] < size:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * self.ratio)))
        return int(np.searchsorted(self.ends, size))

    def differ(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def partitions(self, band: int) -> int:
        """First-level partitions of a band."""
        return math.ceil(SPARE * (self.differ(2 * self.ends[band]) // (self.misses + 1) + 1)) + 1

    def homes(self, size: int) -> list[tuple[int, int]]:
        """(band, partitions that must count) where a set may meet a partner that isn't equal to it: pairs meet in the
        band of the larger set, so that is its own band and, if that may hold a partner, the next one."""
        own, largest = self.band(size), 100 * size // self.percent
        self.band(self.ends[own] + 1)
        out = []
        for band in [own, own + 1] if largest > self.ends[own] else [own]:
            if most := self.differ(size + min(largest, self.ends[band])):
                out.append((band, most // (self.misses + 1) + 1))
        return out


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Distinct signatures of a set of sorted shingle hashes; none if only an equal set can be similar enough."""
    out = [np.zeros(0, np.uint64)]
    for band, wanted in bands.homes(len(shingles)):
        first = bands.partitions(band)
        n = first * bands.cells
        for family in range(FAMILIES):
            h = np.sort(B.mix(shingles, 30 + family))
            cell = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            edges = np.searchsorted(cell, np.arange(n + 1, dtype=np.uint64))
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(B.mix(h, 4), out=sums[1:])
            sums = (sums[edges[1:]] - sums[edges[:-1]]).reshape(first, -1)
            full = np.diff(edges).reshape(first, -1) > 0
            counts = np.cumsum(full.sum(1) > bands.misses)
            enough, last = counts[-1] >= wanted, family == FAMILIES - 1
            taken = int(np.searchsorted(counts, wanted)) + 1 if enough else first
            for k, subset in enumerate(bands.subsets):
                keep = full[:taken, subset].any(1) | (last and not enough)
                tag = np.arange(taken, dtype=np.uint64) * np.uint64(len(bands.subsets)) + np.uint64(k)
                where = B.mix(tag, 1000 + band * FAMILIES + family)
                out.append(B.mix(sums[:taken, subset].sum(1, dtype=np.uint64) ^ where)[keep])
            if enough:
                break
    return np.unique(np.concatenate(out))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE_BYTES of text."""
    sizes = np.array([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def _finger(shingles: np.ndarray) -> int:
    """Name of a set: a 64-bit sum, which doesn't depend on the order."""
    return int(B.mix(np.array([B.mix(shingles, 6).sum(dtype=np.uint64) + np.uint64(len(shingles))]), 7).view(np.int64)[0])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets, _ = B.shingle_sets(batch.column("text"), n)
                yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_finger(s) if len(s) else None for s in sets], pa.int64())], ["__row", "n_shingles", "node"])

    return run


def _signed(n: int, bands: Bands, hot=None):
    """Rows (sig, node, hot) of every set, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within the task; at most one number for each of its rows
        known = hot.value if hot else np.zeros(0, np.int64)
        for whole in batches:
            for batch in _slices(whole, "text"):
                nodes, sigs = [], []
                for s in B.shingle_sets(batch.column("text"), n)[0]:
                    if len(s) and (node := _finger(s)) not in seen:
                        seen.add(node)
                        sigs.append(signatures(s, bands).view(np.int64))
                        nodes.append(np.full(len(sigs[-1]), node, np.int64))
                if sigs:
                    sig, node = np.concatenate(sigs), np.concatenate(nodes)
                    is_hot = known[np.minimum(np.searchsorted(known, sig), len(known) - 1)] == sig if len(known) else np.zeros(len(sig), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(is_hot)], ["sig", "node", "hot"])
        B.give_back()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hot, sig, node): the distinct ones whose signature more than one node has or is hot.

    Memory is one batch."""
    names, last, wanted = ["sig", "node", "hot"], None, False  # the row whose successor isn't known yet, and whether its predecessor has its signature
    for batch in batches:
        sig, node, hot = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(sig):
            continue
        if last is not None:
            sig, node, hot = np.r_[last[0], sig], np.r_[last[1], node], np.r_[last[2], hot]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node, hot = sig[fresh], node[fresh], hot[fresh]
        same = sig[1:] == sig[:-1]
        keep = np.r_[same, False] | np.r_[wanted, same] | hot
        last, wanted = (sig[-1], node[-1], hot[-1]), bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, node, hot)], names)
    if last is not None and wanted:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of a sorted set's shingles in 2^bits cells of the domain."""
    edges = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(B.mix(h, 5), out=sums[1:])
    return np.diff(edges), sums[edges[1:]] - sums[edges[:-1]]


def sketch(shingles: np.ndarray) -> bytes:
    """Counts (255 for more) and 8-bit sums of a sorted set's shingles in cells of the domain: two to four a cell where
    the set isn't larger than the most cells allow."""
    low, high = SKETCH_BITS
    count, total = _cells(shingles, min(high, max(low, (len(shingles) // 2).bit_length() - 1)))
    return np.minimum(count, 255).astype(np.uint8).tobytes() + total.astype(np.uint8).tobytes()


def _folded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and 8-bit sums of sketches, in as many cells as the smallest of them has."""
    cells = min(len(x) for x in sketches) // 2
    count, total = np.empty((len(sketches), cells), np.int16), np.empty((len(sketches), cells), np.uint8)
    for k, x in enumerate(sketches):
        flat = np.frombuffer(x, np.uint8).reshape(2, cells, -1)
        c = flat[0].astype(np.int16)
        count[k] = np.where((c == 255).any(1), 255, np.minimum(c.sum(1), 255))
        total[k] = flat[1].sum(1, dtype=np.uint8)
    return count, total


class _Drawn:
    """Nodes with their sketches, by size."""

    def __init__(self, node: np.ndarray, comp: np.ndarray, size: np.ndarray, sketches: list[bytes], percent: int):
        order = np.argsort(size, kind="stable")
        self.node, self.comp, self.size, self.percent = node[order], comp[order].copy(), size[order], percent
        self.count, self.total = _folded([sketches[k] for k in order])
        self.capped = self.count == 255

    def partners(self, i: int, share: float = 1.0) -> np.ndarray:
        """Later nodes of other components to which sizes and sketches allow a link, the sketches even at a share of the
        difference that a link may have."""
        j = np.arange(i + 1, int(np.searchsorted(self.size, 100 * self.size[i] // self.percent, "right")))
        j = j[self.comp[j] != self.comp[i]]
        if not len(j):
            return j
        unknown = self.capped[j] | self.capped[i]
        apart = np.abs(self.count[j] - self.count[i])
        apart[unknown] = 0
        least = (apart + 2 * ((apart == 0) & ~unknown & (self.total[j] != self.total[i]))).sum(1)
        return j[least <= share * ((100 - self.percent) * (self.size[j] + self.size[i]) // (100 + self.percent))]

    def forest(self) -> list[tuple[int, int]]:
        """Edges that connect all nodes which chains of possible links connect; likely ones are taken first."""
        out = []
        for share in LIKELY:
            for i in range(len(self.node) - 1):
                for k in self.partners(i, share):
                    if self.comp[k] != self.comp[i]:
                        self.comp[self.comp == self.comp[k]] = self.comp[i]
                        out.append((self.node[i], self.node[k]))
        return out

    def possible(self) -> list[tuple[int, int]] | None:
        """All pairs of different components that may link; None if they are more than PAIRS a node."""
        out = []
        for i in range(len(self.node) - 1):
            out += [(self.node[i], self.node[k]) for k in self.partners(i)]
            if len(out) > PAIRS * len(self.node):
                return None
        return out


def _drawn(percent: int, forest: bool):
    """Edges (sig, a, b) of each run of rows (part, sig, node, comp, size, sketch) with one part: a forest, or all
    possible pairs. Where these are too many there is one edge whose ends are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], []
        part0 = sig0 = None

        def finish() -> None:
            if sum(len(h[0]) for h in held) > 1:
                drawn = _Drawn(*(np.concatenate([h[k] for h in held]) for k in range(3)), [x for h in held for x in h[3]], percent)
                pairs = drawn.forest() if forest else drawn.possible()
                found.extend((sig0, i, j) for i, j in ([(None, None)] if pairs is None else pairs))
            held.clear()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["sig", "a", "b"])
            found.clear()
            return batch

        for x in batches:
            part, sig, node, comp, size = (x.column(k).to_numpy() for k in range(5))
            if not len(sig):
                continue
            sketches = x.column(5).to_pylist()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(sig)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if part[i] != part0:
                    finish()
                    part0, sig0 = part[i], sig[i]
                held.append((node[i:j], comp[i:j], size[i:j], sketches[i:j]))
            if found:
                yield rows()
        finish()
        if found:
            yield rows()
        B.give_back()

    return run


def _sketched(n: int):
    """Rows (node, size, sketch, text) of every set, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = B.shingle_sets(batch.column("text"), n)[0]
                names = [_finger(s) if len(s) else None for s in sets]
                keep = []
                for x in names:
                    keep.append(x is not None and x not in seen)
                    seen.add(x)
                drawn = [sketch(s) if k else None for s, k in zip(sets, keep, strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(drawn, pa.binary()), batch.column("text")]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "sketch", "text"]).filter(pa.array(keep, pa.bool_()))
        B.give_back()

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _checked(n: int, percent: int):
    """Rows (a, b) that link, of each run of rows (part, a, b, node, text) with one part: first the part's edges (a, b),
    then its nodes with their texts. An edge is checked as soon as both its texts are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, partners, sets = None, {}, {}
        for whole in batches:
            for x in _slices(whole, "text"):
                found = []
                shingles = B.shingle_sets(x.column("text"), n)[0]
                columns = (x.column(k).to_pylist() for k in ("part", "a", "b", "node"))
                for p, i, j, node, s in zip(*columns, shingles, strict=True):
                    if p != part:
                        part, partners, sets = p, {}, {}
                    if node is None:
                        partners.setdefault(i, []).append(j)
                        partners.setdefault(j, []).append(i)
                        continue
                    sets[node] = s
                    found += [(node, k) for k in partners.get(node, ()) if k in sets and _similar(s, sets[k], percent)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each set of ``left`` with each of ``right`` (indices of sets).

    Elements of one set only count for nothing. Those of at most RARE sets are counted pair by pair, the others by
    products of 0-1 matrices, MATRIX columns at a time.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    times = times[element]
    at = np.full((2, len(sets)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    e, o = element[(times > 1) & (times <= RARE)], owner[(times > 1) & (times <= RARE)]
    for step in range(1, RARE):
        same = np.flatnonzero(e[step:] == e[:-step])
        if not len(same):
            break
        for x, y in ((o[same], o[same + step]), (o[same + step], o[same])):
            i, j = at[0, x], at[1, y]
            met = (i >= 0) & (j >= 0)
            np.add.at(both, (i[met], j[met]), 1)
    e, o = element[times > RARE], owner[times > RARE]
    if len(e):
        column = np.cumsum(np.r_[0, e[1:] != e[:-1]])
        for first in range(0, int(column[-1]) + 1, MATRIX):
            some = (column >= first) & (column < first + MATRIX)
            has = np.zeros((len(sets), min(MATRIX, int(column[-1]) + 1 - first)), np.float32)
            has[o[some], column[some] - first] = 1
            both += has[left] @ has[right].T
    return both


def links_within(nodes: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray, percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that join the components of a group of sets, found by comparing all pairs exactly.

    ``across``: only pairs from the two different blocks.
    """
    size = np.array([len(s) for s in sets])
    left = np.flatnonzero(block == block[0]) if across else np.arange(len(sets))
    right = np.flatnonzero(block != block[0]) if across else left
    if not len(right):
        return []
    both = _shared_counts(sets, left, right)
    linked = 100 * both >= percent * (size[left, None] + size[right] - both)
    out, comp = [], comp.copy()
    for row, i in zip(linked, left, strict=True):
        j = right[row]
        j = j[comp[j] != comp[i]]
        for k in j[np.unique(comp[j], return_index=True)[1]]:
            out.append((int(nodes[i]), int(nodes[k])))
            comp[comp == comp[k]] = comp[i]
    return out


def _linked(n: int, percent: int):
    """Links of each run of rows (part, across, comp, block, node, text) with one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, across, held = None, False, ([], [], [], [])

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held[0]) > 1:
                found = links_within(np.array(held[0]), held[1], np.array(held[2]), np.array(held[3]), percent, across)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for whole in batches:
            for x in _slices(whole, "text"):
                sets = B.shingle_sets(x.column("text"), n)[0]
                columns = (x.column(k).to_pylist() for k in ("part", "across", "node", "comp", "block"))
                for p, far, node, comp, block, s in zip(*columns, sets, strict=True):
                    if p != part:
                        yield from finish()
                        part, across, held = p, far, ([], [], [], [])
                    for h, v in zip(held, (node, s, comp, block), strict=True):
                        h.append(v)
        yield from finish()
        B.give_back()

    return run


def _hot_signatures(texts: DataFrame, rows: int, n: int, bands: Bands):
    """Broadcast signatures that many texts of a sample share; None if there are none.

    The sample is by hash and holds about HOT_SAMPLE texts at most, so the list is bounded. It only decides how rows are
    dealt out; results don't depend on it.
    """
    every = max(HOT_EVERY, rows // HOT_SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(every)) == 0).mapInArrow(_signed(n, bands), "sig long, node long, hot boolean").distinct()
    got = some.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_COUNT).select("sig").collect()
    return texts.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in got), np.int64)) if got else None


def _blocks(n: Column, size: Column | None = None) -> Column:
    """Blocks for so many sets and, if given, bytes of text."""
    blocks = F.ceil(n / F.lit(BLOCK_NODES))
    return (blocks if size is None else F.greatest(blocks, F.ceil(size / F.lit(BLOCK_BYTES)))).cast("int")


def _rest(shared: DataFrame, live: DataFrame, sets: DataFrame, comps: DataFrame | None, found: int) -> DataFrame:
    """Rows (part, across, comp, block, node, text) of live signatures: every two nodes of a signature that aren't in one
    component meet in a part of bounded size.

    The largest component of a signature is its heavy side, whose nodes needn't meet each other. Light nodes meet all.
    A side is cut into blocks, and each pair of blocks with a light one is a part, as is each light block by itself.
    """
    rows = _placed(shared.select("sig", "node").join(live, "sig", "left_semi"), "node", "comp", comps, found)
    sizes = rows.join(sets.select("node", F.octet_length("text").alias("bytes")), "node").groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    whole = sizes.groupBy("sig").agg(F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "bytes", "comp")).alias("most"))
    light = _blocks(F.col("all") - F.col("most.n"), F.col("all_bytes") - F.col("most.bytes"))
    small = _blocks(F.col("all"), F.col("all_bytes")) <= 1
    whole = whole.where("all > most.n").select(
        "sig", F.when(small, F.lit(None).cast("long")).otherwise(F.col("most.comp")).alias("heavy"), F.when(small, 1).otherwise(light).alias("light"),
        F.when(small, 0).otherwise(_blocks(F.col("most.n"), F.col("most.bytes"))).alias("more"),
    )
    rows = rows.join(whole, "sig").withColumn("weighs", F.col("comp").eqNullSafe(F.col("heavy")))
    own = F.when(F.col("weighs"), F.col("light") + F.pmod(F.xxhash64("node"), F.col("more"))).otherwise(F.pmod(F.xxhash64("node"), F.col("light"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("weighs"), F.col("light")).otherwise(F.col("light") + F.col("more")) - 1)
    rows = rows.withColumn("block", own).withColumn("other", F.explode(meets))
    part = F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(part.alias("part"), (F.col("block") != F.col("other")).alias("across"), "comp", "block", "node")
    return rows.join(sets.select("node", "text"), "node").select("part", "across", "comp", "block", "node", "text")


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of texts: (id_col, n_shingles, component_id) for each row of df.

    Words are runs of anything but space and U+0009 to U+000D after A-Z are lower-cased; a set holds the distinct
    shingles of ``n`` words, or the whole sequence where there are fewer. Two rows link when
    100 * |intersection| >= percent * |union|, and component_id is the smallest id reachable by links.

    Rows with equal sets count as one node throughout, so copies are never paired with each other. Work is done within
    signatures, never within components. First, each signature gives a forest of edges between nodes whose sizes and
    sketches allow a link, likely ones first, and all edges are checked exactly. Their links give components. A signature
    whose forest still has an edge between two components goes on: its pairs of different components that sketches allow
    are checked too. Where they are more than PAIRS for each of its nodes they aren't laid out; all pairs but those of
    its largest component are then compared in parts of BLOCK_NODES sets and BLOCK_BYTES of text a side. Every pair that
    shares a signature is thus in one component, ruled out by its sketch, or checked. A signature that very many sets
    share is dealt out by node before its blocks are cut.

    Null and empty texts and texts without words have no shingles and link with nothing, component_id being their own
    id. Rows with a null id take part; a component's id is its smallest non-null id, or null without any. Repeated rows
    each give a row. An empty df gives an empty result. Other columns of df are ignored, whatever their names. Shingles
    and nodes are 64-bit hashes; the chance of a wrong link is about the square of the number of distinct texts / 2^64.
    """
    spark, bands = df.sparkSession, Bands(percent)
    docs = df.select(F.col(id_col).alias("__row"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["__row"].dataType.simpleString()
    rows = materialize(docs.mapInArrow(_sets(n), f"__row {kind}, n_shingles long, node long"), "sets")
    temporary = [rows]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def kept(table: DataFrame, name: str) -> DataFrame:
        temporary.append(materialize(table, name))
        return temporary[-1]

    texts = docs.select("text").where("text is not null")
    hot = _hot_signatures(texts, rows.count(), n, bands)
    place = F.when(F.col("hot"), F.xxhash64("sig", "node")).otherwise(F.col("sig"))
    signed = texts.mapInArrow(_signed(n, bands, hot), "sig long, node long, hot boolean")
    signed = signed.repartition(parts, place).sortWithinPartitions("hot", "sig", "node")
    shared = kept(signed.mapInArrow(_runs, "sig long, node long, hot boolean").select("sig", "node"), "shared")
    # Copies of each other share many signatures: of those with the same nodes one will do.
    alike = shared.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    once = alike.where("n > 1").groupBy("x", "y", "n", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig", "n")
    once = kept(once, "once")
    found, comps = 0, None
    if held := once.count():
        every, shared = shared, kept(shared.join(maybe_broadcast(once, held), "sig").select("sig", "node", "n"), "shared")
        discard(spark, every.stored_at)
        nodes = kept(shared.select("node").distinct(), "nodes")
        sets = docs.mapInArrow(_sketched(n), "node long, size long, sketch binary, text string").join(maybe_broadcast(nodes, nodes.count()), "node", "left_semi")
        sets = kept(sets.dropDuplicates(["node"]), "candidates")
        part = F.when(F.col("n") <= BLOCK_NODES, F.col("sig")).otherwise(F.xxhash64("sig", F.pmod(F.xxhash64("node"), _blocks(F.col("n")))))
        sketches, edge = sets.select("node", "size", "sketch"), "sig long, a long, b long"
        near = shared.join(sketches, "node").select(part.alias("part"), "sig", "node", F.col("node").alias("comp"), "size", "sketch")
        near = near.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_drawn(percent, True), edge)
        near = kept(near.join(maybe_broadcast(once, held), "sig"), "forest")
        links = spark.createDataFrame([], "a long, b long")

        def checked(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
            """Distinct edges of unknown outcome, the links among which join ``links``."""
            nonlocal links, comps, found
            pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = kept(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "pairs")
            if several := pairs.count():
                temporary.append(groups := components(pairs, "groups"))
                meet = _meetings(pairs, sets, groups, 2 * several).repartition(parts, "part").sortWithinPartitions("part", F.col("node").asc_nulls_first())
                joined(kept(meet.mapInArrow(_checked(n, percent), "a long, b long"), "links"))
            return pairs

        def joined(more: DataFrame) -> None:
            nonlocal links, comps, found
            if again := more.count():
                links, found = links.union(more), found + again
                temporary.append(comps := components(links))

        tried = checked(near)
        live = kept(_live(near, shared, comps, found), "live")
        if live.count():
            again = _placed(shared.where(F.col("n") <= BLOCK_NODES).select("sig", "node").join(live, "sig", "left_semi"), "node", "comp", comps, found)
            again = again.join(sketches, "node").select(F.col("sig").alias("part"), "sig", "node", "comp", "size", "sketch")
            again = kept(again.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_drawn(percent, False), edge), "possible")
            checked(again.where("a is not null"), tried)
            dense = shared.where(F.col("n") > BLOCK_NODES).select("sig").join(live, "sig", "left_semi").union(again.where("a is null").select("sig")).distinct()
            dense = kept(dense, "dense")
            if dense.count():
                more = _rest(shared, dense, sets, comps, found).repartition(parts, "part").sortWithinPartitions("part")
                joined(kept(more.mapInArrow(_linked(n, percent), "a long, b long"), "links"))
    if comps is not None:
        rows = rows.join(maybe_broadcast(comps, 2 * found), "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    low = rows.where("node is not null").groupBy("node").agg(F.min("__row").alias("component_id"))
    out = rows.join(low, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("__row")).otherwise(F.col("component_id"))
    out = materialize(out.select(F.col("__row").alias(id_col), "n_shingles", alone.alias("component_id")), "classes")
    for x in temporary:
        discard(spark, x.stored_at)
    return out


def _placed(t: DataFrame, node: str, name: str, comps: DataFrame | None, found: int) -> DataFrame:
    """t with the component of a node, which is the node itself where it has no link."""
    if comps is None:
        return t.withColumn(name, F.col(node))
    there = maybe_broadcast(comps.select(F.col("node").alias(node), F.col("component").alias(name)), 2 * found)
    return t.join(there, node, "left").withColumn(name, F.coalesce(name, node))


def _meetings(pairs: DataFrame, sets: DataFrame, groups: DataFrame, grouped: int) -> DataFrame:
    """Rows (part, a, b, node, text) for _checked(): each pair (a, b), and each of its nodes with its text.

    Pairs of one connected group meet in one part, so that most texts travel once. A group of more than BLOCK_NODES sets
    or BLOCK_BYTES of text is cut into blocks of nodes, and a pair's part is that of its two blocks.
    """
    sizes = sets.select("node", F.octet_length("text").alias("bytes")).join(maybe_broadcast(groups, grouped), "node")
    wide = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select("component", _blocks(F.col("n"), F.col("bytes")).alias("blocks")).where("blocks > 1")
    wide = F.broadcast(wide) if grouped <= BROADCAST_ROWS * BLOCK_NODES else wide  # a wide group has more than BLOCK_NODES sets or BLOCK_BYTES
    named = pairs.join(maybe_broadcast(groups.withColumnRenamed("node", "a"), grouped), "a").join(wide, "component", "left")
    block = lambda node: F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(node), F.col("blocks")))
    named = named.select(F.xxhash64("component", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("part"), "a", "b")
    ends = named.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = sets.select("node", "text").join(ends, "node")
    none = F.lit(None).cast("long")
    return named.select("part", "a", "b", none.alias("node"), F.lit(None).cast("string").alias("text")).union(texts.select("part", none, none, "node", "text"))


def _live(forest: DataFrame, shared: DataFrame, comps: DataFrame | None, found: int) -> DataFrame:
    """Signatures (sig) in which nodes of different components may still link: a forest has an edge between components
    and it isn't the only pair, or the signature was cut into blocks, between which no edges were sought."""
    wide = _placed(shared.where(F.col("n") > BLOCK_NODES), "node", "comp", comps, found)
    wide = wide.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    open_ = _placed(_placed(forest.where(F.col("n").between(3, BLOCK_NODES)), "a", "comp_a", comps, found), "b", "comp_b", comps, found)
    return open_.where("comp_a <> comp_b").select("sig").distinct().union(wide)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each near-duplicate class: that with the smallest id, a null id coming last.

    Of several rows with that id one stays: that with the smallest hash of its text, or any of those with one text. Ids
    name no rows: classes are those of texts, whether ids repeat or are null. Rows without words are kept.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0).cast("long")).alias("hash"))
    classes = ngram_jaccard_join(df.select(key.alias("__key"), F.col(text_col).alias("text")), "__key", "text", n, percent)
    classes = classes.where("n_shingles > 0").groupBy("__key").agg(F.first("component_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    # Keys that go, and of those that stay the ones that several rows have: only these rows' texts travel.
    odd = materialize(classes.select(F.col("__key.id").alias("__i"), F.col("__key.hash").alias("__h"), (F.col("low") != F.col("__key")).alias("__gone"), "rows").where("__gone or rows > 1"), "odd-keys")
    on = (F.xxhash64(text_col) == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__i"))
    once = df.join(odd, on, "left_anti")
    twice = df.join(odd.where("not __gone"), on, "left_semi").withColumn("__h", F.xxhash64(text_col)).dropDuplicates([id_col, "__h"])
    return once.union(twice.select(df.columns))


def op2_partenum_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_join(docs, n=4, percent=85)


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from words union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
low as (select a, min(b) as b from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, low.b as component_id
from words left join sizes using (doc_id) join low on low.a = doc_id
"""
