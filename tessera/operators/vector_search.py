"""Vector search: exact top-k by dot product or cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Refusal
from tessera.plans.contract import Contract

#: Most neighbours that a search returns, and the default.
MAX_K, DEFAULT_K = 10, 5


def dot(c: Column, vector: Sequence[float]) -> Column:
    """Product with a literal vector, inside the JVM."""
    other = F.array(*[F.lit(float(x)) for x in vector])
    return F.aggregate(F.zip_with(c, other, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def top_k(df: DataFrame, vector_col: str, id_col: str, query: Sequence[float], k: int | None = None, metric: str = "cosine") -> DataFrame:
    """The k (1 to 10, default 5) rows with the highest ``score``; ties by smaller id. Rows whose vector is null or of
    another length, and for cosine zero vectors, take no part. Each task keeps its k best: nothing is sorted as a whole."""
    k = max(1, min(int(k or DEFAULT_K), MAX_K))
    df = df.where(F.size(vector_col) == len(query))
    score = dot(F.col(vector_col), query)
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        score = F.try_divide(score, norm * F.lit(sum(x * x for x in query) ** 0.5))
    elif metric != "dot":
        raise Refusal("metric_not_supported", metric)
    return df.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def search_vector(spark: SparkSession, contract: Contract, table: str, vector: Sequence[float], vector_col: str, id_col: str, k: int | None = None, metric: str = "cosine") -> DataFrame:
    """top_k over a governed table, with the declared columns but the vector."""
    contract.require_valid()
    return top_k(contract.table(spark, table, keep_missing=True), vector_col, id_col, vector, k, metric).drop(vector_col)


def stored_vector(df: DataFrame, id_col: str, vector_col: str, row_id) -> list[float]:
    """The vector of one row, to search with."""
    row = df.where(F.col(id_col) == row_id).select(vector_col).first()
    if row is None:
        raise Refusal("query_vector_missing", str(row_id))
    return list(row[0])
