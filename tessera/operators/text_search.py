"""Text search: BM25 over declared text fields, in DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.errors import Refusal
from tessera.operators.documents import column_of
from tessera.plans.contract import Contract
from tessera.plans.roles import columns_with
from tessera.plans.semantic_plan import MAX_IN, clamp, ties

#: Saturation and length normalisation of BM25.
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def query_terms(query: str) -> list[str]:
    out, word = [], ""
    for ch in query.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return sorted(set(out))


def bm25(df: DataFrame, columns: str | Sequence[str], terms: Sequence[str], name: str = "_score") -> DataFrame:
    """df's rows with a term in one of the columns, with the score of the column that scores best.

    One aggregation finds each column's statistics: number of rows, mean length, and each term's document frequency, a
    single row whatever the collection's size. Scores are then a map over the rows that contain a term as a string,
    which is told without splitting them into words.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    size = lambda k: F.size(F.col(f"__t{k}"))
    split = {f"__t{k}": tokens(F.col(c)) for k, c in enumerate(columns)}
    has = lambda k, t: F.array_contains(F.col(f"__t{k}"), t)
    measures = [m for k in range(len(columns)) for m in (F.avg(size(k)).alias(f"mean{k}"), *[F.count_if(has(k, t)).alias(f"df{k}_{j}") for j, t in enumerate(terms)])]
    stats = df.select(*columns).withColumns(split).agg(F.count(F.lit(1)).alias("n"), *measures).first()
    near = reduce(Column.__or__, [F.contains(F.lower(F.col(c)), F.lit(t)) for c in columns for t in terms])
    scores = []
    for k in range(len(columns)):
        score = F.lit(0.0)
        for j, t in enumerate(terms):
            often = stats[f"df{k}_{j}"]
            f = (size(k) - F.size(F.array_remove(F.col(f"__t{k}"), t))).cast("double")
            score += F.lit(math.log(1 + (stats["n"] - often + 0.5) / (often + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * size(k) / F.lit(stats[f"mean{k}"] or 1.0)))
        scores.append(score)
    some = reduce(Column.__or__, [has(k, t) for k in range(len(columns)) for t in terms])
    out = df.where(near).withColumns(split).where(some).withColumn(name, F.greatest(*scores) if len(scores) > 1 else scores[0])
    return out.drop(*split)


def search_text(
    spark: SparkSession, contract: Contract, table: str, query: str | None = None, filters: Mapping[str, Any] | None = None, limit: int | None = None, id_column: str | None = None,
) -> DataFrame:
    """Rows that match a word of the query in a text or name field, best field counts, by falling ``_score``.

    Filters are exact terms; a list means one of them (500 at most). Exclusions apply, rows with a missing value stay,
    and excluded values are taken out of lists: a request for nothing else has no rows. Ties go by the id column.
    """
    contract.require_valid()
    if table not in contract.data["tables"]:
        raise Refusal("table_not_allowed", table)
    df = contract.table(spark, table, keep_missing=True)
    arrays = {f.name for f in df.schema if isinstance(f.dataType, ArrayType)}
    for key, value in (filters or {}).items():
        name = column_of(contract, table, key)
        banned = {x["value"] for x in contract.exclusions(table) if x["column"] == name}
        values = value if isinstance(value, (list, tuple)) else [value]
        if len(values) > MAX_IN:
            raise Refusal("filter_list_too_long", f"{key}: {MAX_IN} values at most")
        values = [v for v in values if v not in banned]
        if not values:
            df = df.where(F.lit(False))
        else:
            df = df.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if name in arrays else F.col(name).isin(values))
    order = id_column or next(iter(columns_with(contract.data, table, "identity")), df.columns[0])
    terms = query_terms(query or "")
    if not terms:
        return df.withColumn("_score", F.lit(1.0)).orderBy(order, *ties(df, [c for c in df.columns if c != order])).limit(clamp(limit, default=20))
    fields = columns_with(contract.data, table, "body_text", "display_name")
    if not fields:
        raise Refusal("text_search_fields_unresolved", table)
    out = bm25(df, fields, terms)
    rest = [c for c in df.columns if c != order]
    return out.orderBy(F.desc("_score"), F.asc(order), *ties(out, rest)).limit(clamp(limit, default=20))
