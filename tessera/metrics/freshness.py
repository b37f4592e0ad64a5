"""How old an entity's data is, against a metric's or the source's limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import Refusal
from tessera.metrics.kernel import Kernel, Metric


def freshness(df: DataFrame, time_field: str, reference_date: str, max_age_days: int) -> DataFrame:
    """One row: last_day, age_days, stale. No rows and only null times are stale."""
    last = F.max(time_field).cast("date")
    age = F.date_diff(F.lit(reference_date).cast("date"), F.col("last_day"))
    return df.agg(last.alias("last_day")).withColumn("age_days", age.cast("long")).withColumn("stale", F.coalesce(F.col("age_days") > max_age_days, F.lit(True)))


def limit_of(kernel: Kernel, m: Metric) -> int | None:
    """The metric's limit, else the source's."""
    return m.max_age_days if m.max_age_days is not None else kernel.source_max_age_days


def require_fresh(kernel: Kernel, m: Metric, df: DataFrame, time_field: str | None, reference_date: str) -> list[str]:
    """Caveats; a stale metric with a hard limit is refused."""
    limit = limit_of(kernel, m)
    if limit is None or time_field is None:
        return []
    row = freshness(df, time_field, reference_date, limit).first()
    if not row["stale"]:
        return []
    if m.sla == "hard":
        raise Refusal("METRIC_DATA_STALE", f"{m.id}: last day {row['last_day']}, limit {limit} days")
    return ["stale_data"]
