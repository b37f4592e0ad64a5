"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one full-dimensional codeword from each codebook, found by beam search. Its index
entry is the codeword numbers and the approximation's squared norm. A query's distances to all entries follow from a
lookup table of its products with all codewords; the best of each block of entries are ranked anew by exact distances,
and then all others whose approximate distance less their quantisation error isn't above the worst of those kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, materialize

#: Bound of the training sample, in vectors; codebooks; codewords of each; width of the beam; rounds of k-means.
SAMPLE, BOOKS, WORDS, BEAM, ROUNDS = 8192, 8, 256, 4, 6
#: Entries of an index block, entries of it that are ranked exactly first for each query, queries of a block.
BLOCK, SHORT, QUERIES = 4096, 256, 1024
#: Pairs of a query and an entry whose exact distances are reckoned at once.
PAIRS = 1 << 16
#: Index blocks and query blocks that one task holds at once.
HELD, HELD_QUERIES = 32, 64


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * (x @ words.T)).argmin(1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Codebooks (book, word, dimension) for the rows of x: residual k-means, then one least-squares update of all
    codewords for the beam-search codes."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    out, rest = np.zeros((books, words, x.shape[1]), np.float32), x.astype(np.float32)
    for m in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(rest, centre)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            n = np.bincount(near, minlength=words)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        out[m] = centre
        rest = rest - centre[_nearest(rest, centre)]
    if len(x) > books * words // 4:
        codes, _ = encode(x, out)
        flat = codes.astype(np.int64) + words * np.arange(books)
        gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(right, flat[:, m], x)
            for k in range(books):
                np.add.at(gram, (flat[:, m], flat[:, k]), 1.0)
        anchor = 1.0  # keeps rarely used codewords near where they were
        right += anchor * out.reshape(-1, x.shape[1])
        out = np.linalg.solve(gram + anchor * np.eye(len(gram)), right).astype(np.float32).reshape(out.shape)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, book) of the beam search's best sum for each row of x, and the sums' squared norms."""
    x = x.astype(np.float32)
    n, (count, words, dim) = len(x), books.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, count), np.uint8 if words <= 256 else np.uint16)
    for m in range(count):
        norm = (books[m] ** 2).sum(1)
        width = rest.shape[1]
        cost = ((rest**2).sum(2)[:, :, None] + norm - 2 * (rest.reshape(-1, dim) @ books[m].T).reshape(n, width, words)).reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        state, word = best // words, best % words
        codes = np.take_along_axis(codes, state[:, :, None], 1)
        codes[:, :, m] = word
        rest = np.take_along_axis(rest, state[:, :, None], 1) - books[m][word]
    best = (rest**2).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, best], ((x - rest[rows, best]) ** 2).sum(1)


def shortlist(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (query, place) with the smallest approximate distances, equal ones by smaller id, and all entries' squared
    approximate distances less the query's squared norm. ids must be sorted."""
    table = np.einsum("qd,mwd->qmw", queries.astype(np.float32), books)
    score = np.broadcast_to(norms.astype(np.float32), (len(queries), len(codes))).copy()
    for m in range(len(books)):
        score -= 2 * table[:, m][:, codes[:, m]]
    keep = min(keep, len(codes))
    if keep == len(codes):
        return np.broadcast_to(np.arange(keep), score.shape), score
    edge = np.partition(score, keep - 1, axis=1)[:, keep - 1 : keep]
    # All below the edge, then those on it from the smallest id on.
    rank = np.where(score < edge, 0, np.where(score == edge, 1, 2)).astype(np.int8)
    return np.argsort(rank, axis=1, kind="stable")[:, :keep], score


def within(q: np.ndarray, x: np.ndarray, books: np.ndarray, score: np.ndarray, errors: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Whether each entry (query, place) may be no further from the query than ``worst`` (one for each query).

    An entry's distance is at least its approximate distance less its quantisation error; what that leaves over is
    looked at by products of the vectors. Both allow for rounding, and a bound that isn't finite rules nothing out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        long = np.sqrt((q**2).sum(1))[:, None]
        reach = np.sqrt((books.astype(np.float64) ** 2).sum(2)).max(1).sum()
        low = long**2 + score - (q.shape[1] + 16) * 2.0**-23 * (long + reach) ** 2
        low = np.where(np.isfinite(low), np.sqrt(np.maximum(low, 0)) - errors, -np.inf)
        may = ~(low > worst[:, None])
        some = np.flatnonzero(may.any(0))
        if len(some):
            y = x[some]
            size = np.sqrt((y**2).sum(1))
            square = long**2 + size**2 - 2 * (q @ y.T) - (q.shape[1] + 16) * 2.0**-50 * (long + size) ** 2
            may[:, some] &= ~(square > worst[:, None] ** 2)
    return may


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision over the last axis. Components whose squares would overflow are scaled
    by a power of two first, which rounds nothing."""
    gap = x - y
    top = np.abs(gap).max(-1, initial=0.0)
    odd = np.isfinite(top) & ((top > 1e150) | (top < 1e-140))
    if not odd.any():
        return np.sqrt((gap**2).sum(-1))
    power = np.where(odd, np.frexp(top)[1], 0)
    return np.ldexp(np.sqrt((np.ldexp(gap, -power[..., None]) ** 2).sum(-1)), power)


def _matrix(blob: bytes, kind, width: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, width)


def _index(books, salts: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                ids = batch.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                x = batch.column(1).flatten().to_numpy().reshape(-1, dim)[order]
                ids = ids[order]
                parts = [encode(x[i : i + 512], b) for i in range(0, len(x), 512)]
                codes, norms = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
                salt = int(np.bitwise_xor.reduce(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % salts
                errors = np.sqrt(((x - sum(b[m].astype(np.float64)[codes[:, m]] for m in range(len(b)))) ** 2).sum(1))
                row = [[salt], [ids.tobytes()], [np.ascontiguousarray(x).tobytes()], [codes.tobytes()], [norms.astype(np.float32).tobytes()], [errors.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *[pa.array(v, pa.binary()) for v in row[1:]]], ["salt", "ids", "vectors", "codes", "norms", "errors"])

    return run


def _search(books, dim: int, kind: str, top: int, short: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        b = books.value
        found = []
        for qb in range(queries.num_rows):
            qid = np.frombuffer(queries.column("qids")[qb].as_py(), np.int64)
            q = _matrix(queries.column("qvectors")[qb].as_py(), kind, dim).astype(np.float64)
            best = np.full((len(q), top), np.inf)  # of all blocks so far
            for k in range(blocks.num_rows):
                ids = np.frombuffer(blocks.column("ids")[k].as_py(), np.int64)
                x = _matrix(blocks.column("vectors")[k].as_py(), kind, dim).astype(np.float64)
                codes = _matrix(blocks.column("codes")[k].as_py(), np.uint8 if b.shape[1] <= 256 else np.uint16, len(b))
                norms = np.frombuffer(blocks.column("norms")[k].as_py(), np.float32)
                errors = np.frombuffer(blocks.column("errors")[k].as_py(), np.float64)
                for i in range(0, len(q), 128):
                    mine, me = q[i : i + 128], qid[i : i + 128, None]
                    near, score = shortlist(mine, b, codes, norms, ids, short + 1)
                    d = np.full(score.shape, np.inf)
                    np.put_along_axis(d, near, distances(x[near], mine[:, None]), 1)
                    d[ids == me] = np.inf
                    last = min(top, len(ids)) - 1
                    worst = np.partition(d, last, axis=1)[:, last] if top <= len(ids) else np.full(len(mine), np.inf)
                    worst = np.minimum(worst, best[i : i + 128, -1])
                    may = within(mine, x, b, score, errors, worst) & (ids != me)
                    np.put_along_axis(may, near, False, 1)
                    row, at = np.nonzero(may)
                    for s in range(0, len(row), PAIRS):
                        r, c = row[s : s + PAIRS], at[s : s + PAIRS]
                        d[r, c] = distances(x[c], mine[r])
                    edge = np.partition(d, last, axis=1)[:, last]
                    for r in range(len(mine)):
                        c = np.flatnonzero((d[r] <= edge[r]) & np.isfinite(d[r]))
                        c = c[np.argsort(d[r, c], kind="stable")[:top]]  # ids are sorted
                        found.append((np.full(len(c), me[r, 0]), ids[c], d[r, c]))
                        best[i + r] = np.sort(np.r_[best[i + r], d[r, c]])[:top]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def _packed(dim: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({"qb": pa.array([table.column("qb")[0].as_py()], pa.int32()), "qids": pa.array([ids.tobytes()], pa.binary()), "qvectors": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    return run


def nearest_neighbours(df: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", short: int = SHORT) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its nearest rows of df other than those with its id.

    Nearness is Euclidean distance, the score, in double precision on the original vectors; ties go to smaller ids. The
    codebooks are fitted on at most SAMPLE vectors, taken by hash; every vector is indexed. Of each block of BLOCK entries
    the ``short`` approximately nearest are ranked exactly, and then every entry that by its approximate distance less
    its quantisation error may be among the ``top``, so no neighbour is lost, however alike the vectors are.

    Vectors that are null or zero, hold null or non-finite components, or have another length than most of the sample
    take no part, nor do rows with null ids. Queries that repeat an id count once, with the smallest vector. A repeated
    row of df counts as often as it occurs. Empty tables give an empty result. Other columns are ignored, whatever their names.

    Index blocks and query blocks meet in groups of HELD and HELD_QUERIES of them at most on average: each query block
    goes to every salt of index blocks, and the index is copied once for each HELD_QUERIES * QUERIES queries, not for
    each block of them. What is broadcast is the codebooks, whose size is fixed. The driver receives about SAMPLE vectors,
    whatever the number of tasks.
    """
    spark = df.sparkSession
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kind = df.schema[vector_col].dataType.elementType.simpleString()

    def good(d: DataFrame) -> DataFrame:
        d = d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
        return d.where(finite("v") & F.exists("v", lambda x: x != 0))

    base = good(df)
    hashed = base.withColumn("h", F.xxhash64("id", "v"))
    rows = [r["v"] for r in hash_share(hashed, F.col("h"), SAMPLE, base.count()).orderBy("h", "id").limit(SAMPLE).collect()]
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(r) for r in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sample = np.array([r for r in rows if len(r) == dim], np.float64 if kind == "double" else np.float32)
    fair = np.abs(sample).max(1) < 1e15  # codebooks are in single precision; vectors beyond it are found by their error
    books = spark.sparkContext.broadcast(fit(sample[fair] if fair.any() else sample / np.abs(sample).max()))
    numpy_kind = {"float": "f4", "double": "f8"}.get(kind, "f8")
    fixed = lambda d: d.where(F.size("v") == dim).select("id", F.col("v").cast(f"array<{'float' if numpy_kind == 'f4' else 'double'}>").alias("v"))
    base = fixed(base)
    asked = materialize(fixed(good(queries)).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    entries, n = base.count(), asked.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salts = max(parts, math.ceil(entries / (BLOCK * HELD)))
    count = max(1, math.ceil(n / QUERIES))
    wide = math.ceil(count / HELD_QUERIES)

    index = materialize(base.mapInArrow(_index(books, salts, dim), "salt int, ids binary, vectors binary, codes binary, norms binary, errors binary"), "ann-index")
    packed = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy("qb").applyInArrow(_packed(dim), "qb int, qids binary, qvectors binary")
    left = packed.withColumn("qg", (F.col("qb") % wide).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = index.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    got = left.groupBy("qg", "salt").cogroup(right.groupBy("qg", "salt")).applyInArrow(_search(books, dim, numpy_kind, top, short), "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return got.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_additive_quantiser(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
