"""Federation: a bounded join of two earlier results, with conflicts reported and citations derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import Refusal
from tessera.functions.matching import normalised
from tessera.plans.contract import Contract

#: Most rows of a side and of the result, and the default of the result.
MAX_SLICE, DEFAULT_ROWS = 500, 100
CITATION = "_citation"

#: Conflict checks: whether two values of a shared field disagree.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {"differs": lambda a, b: ~a.eqNullSafe(b)}


def register_check(name: str, check: Callable[[Column, Column], Column]) -> None:
    CHECKS[name] = check


def _gate(df: DataFrame, key: str, side: str) -> int:
    if key not in df.columns:
        raise Refusal("join_key_missing", f"{side}: {key}")
    row = df.limit(MAX_SLICE + 1).agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("keys")).first()
    if row["n"] > MAX_SLICE:
        raise Refusal("federation_slice_too_large", f"{side}: more than {MAX_SLICE} rows")
    if row["n"] and not row["keys"]:
        raise Refusal("join_key_missing", f"{side}: no row has {key}")
    return row["n"]


def _related(contract: Contract, left: str | None, right: str | None) -> None:
    """Both sources being declared, a relation must connect this pair; an unknown one isn't checked."""
    known = contract.data["sources"]
    if left in known and right in known:
        pairs = {frozenset((r["left"].split(".")[0], r["right"].split(".")[0])) for r in contract.data["relations"]}
        if frozenset((left, right)) not in pairs:
            raise Refusal("relation_not_declared", f"{left} and {right}")


def source_of(df: DataFrame) -> str | None:
    """The source of a slice by its citations; None without citations or where they name several sources."""
    if CITATION not in df.columns or "source_id" not in df.select(f"{CITATION}.*").columns:
        return None
    found = [r[0] for r in df.select(F.col(f"{CITATION}.source_id")).distinct().limit(2).collect()]
    return found[0] if len(found) == 1 else None


def combine_slices(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, strategy: str = "exact", limit: int | None = None, order: tuple[list[str], list[str]] | None = None,
    contract: Contract | None = None, sources: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Inner join of two slices of at most 500 rows: every left column as left_*, every right one as right_*.

    Rows come by the left's order, then the right's (``order``: columns that sort each; default all of them), and the
    limit (1 to 500, default 100) keeps the first. Null keys never match, and keys of different kinds are not cast.
    ``_conflicts`` lists shared fields, without keys and those that begin with an underscore, whose values disagree;
    ``_citation`` appears where a side has one, and supports claims only if both do. ``sources``: what each slice is
    from, by default what its citations say; a relation of the contract must connect them.
    """
    if contract is not None:
        contract.require_valid()
        _related(contract, *(named or source_of(df) for named, df in zip(sources, (left, right), strict=True)))
    for df, key, side in ((left, left_key, "left"), (right, right_key, "right")):
        _gate(df, key, side)
    kinds = dict(left.dtypes)[left_key], dict(right.dtypes)[right_key]
    texts = [k.startswith(("string", "varchar", "char")) for k in kinds]
    bound = max(1, min(int(limit or DEFAULT_ROWS), MAX_SLICE))
    sides = []
    for df, key, side, kind, columns in ((left, left_key, "left", kinds[0], order and order[0]), (right, right_key, "right", kinds[1], order and order[1])):
        by = [F.col(c).asc_nulls_last() for c in columns or [c for c, t in df.dtypes if c != CITATION and not t.startswith("map")]]
        numbered = df.withColumn(f"__{side}", F.row_number().over(Window.orderBy(*by)))  # 500 rows at most
        sides.append(numbered.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], f"__{side}", normalised(F.col(key), strategy, kind).alias(f"__key_{side}")))
    on = F.col("__key_left") == F.col("__key_right") if texts[0] == texts[1] else F.lit(False)
    out = sides[0].join(sides[1], on, "inner").orderBy("__left", "__right").limit(bound)
    shared = sorted(c for c in set(left.columns) & set(right.columns) - {left_key, right_key} if not c.startswith("_"))
    made = []
    for c in shared:
        a, b = F.col(f"left_{c}"), F.col(f"right_{c}")
        found = F.lit(False)
        for check in CHECKS.values():
            found |= check(a, b)
        made.append(F.when(found, F.struct(F.lit(c).alias("field"), a.cast("string").alias("left"), b.cast("string").alias("right"))))
    empty = F.array().cast("array<struct<field:string,left:string,right:string>>")
    out = out.withColumn("_conflicts", F.array_compact(F.array(*made)) if made else empty)
    if cited := [s for s, df in (("left", left), ("right", right)) if CITATION in df.columns]:
        out = out.withColumn(CITATION, derived(*[F.col(f"{s}_{CITATION}") for s in cited]))
    return out.drop("__left", "__right", "__key_left", "__key_right")


def derived(*citations: Column) -> Column:
    """Citation of a row that was made from cited rows."""
    from tessera.functions.hashing import row_id

    ids = F.array_sort(F.array_distinct(F.array(*[c["evidence_id"] for c in citations])))
    may = citations[0]["may_support_claims"]
    for c in citations[1:]:
        may = may & c["may_support_claims"]
    return F.struct(
        F.lit("derived").alias("kind"), row_id("ev:", F.array_join(ids, ",")).alias("evidence_id"), ids.alias("supporting_evidence_ids"),
        F.array_sort(F.array_distinct(F.array(*[c["source_id"] for c in citations]))).alias("source_ids"), F.coalesce(may, F.lit(True)).alias("may_support_claims"),
    )


def conflicts(joined: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each disagreement: keys, field, left, right."""
    return joined.select(*keys, F.explode("_conflicts").alias("c")).select(*keys, "c.field", "c.left", "c.right")


def may_support(joined: DataFrame) -> bool:
    """Whether all pairs may support claims; pairs without a citation count as yes, and so does an empty result."""
    if CITATION not in joined.columns:
        return True
    row = joined.agg(F.min(F.coalesce(F.col(f"{CITATION}.may_support_claims"), F.lit(True))).alias("x")).first()
    return True if row["x"] is None else row["x"]
