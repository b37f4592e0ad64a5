"""Reporting periods as inclusive date ranges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import Clarify

#: Names of grains and period macros.
GRAINS = ("day", "week", "month")
PERIODS = ("last_30_days", "ytd", "prior_period")


def period_range(name: str, reference: date | str | None, days: int = 30) -> tuple[date, date]:
    """First and last day. last_30_days ends on the reference day, ytd begins on 1 January, prior_period is the calendar
    month before the reference day's."""
    if reference is None:
        raise Clarify("reference_date_required", f"period {name} needs a reference date")
    ref = date.fromisoformat(reference) if isinstance(reference, str) else reference
    if name == "last_30_days":
        return ref - timedelta(days=days - 1), ref
    if name == "ytd":
        return ref.replace(month=1, day=1), ref
    if name == "prior_period":
        last = ref.replace(day=1) - timedelta(days=1)
        return last.replace(day=1), last
    raise Clarify("unknown_period", name, list(PERIODS))


def within(c: Column, first: date, last: date) -> Column:
    """Whether a date or timestamp falls on one of the days; times after midnight on the last day do."""
    return (c >= F.lit(first)) & (c < F.lit(last + timedelta(days=1)))


def bucket(c: Column, grain: str) -> Column:
    """First day of the grain's bucket as a date; weeks begin on Monday."""
    if grain not in GRAINS:
        raise Clarify("unsupported_grain", grain, list(GRAINS))
    return F.date_trunc(grain, c).cast("date")
