"""Metadata events: what changed, which terms that touches, which wait for a new certificate. The functions take batch
and streaming DataFrames alike; the stream keeps one row for each reference and window until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of events.
KINDS = ("definition_changed", "schema_changed", "source_refreshed", "certification_failed")
SCHEMA = "event_id string, kind string, ref string, at timestamp"


def touched_terms(events: DataFrame, terms: DataFrame) -> DataFrame:
    """(event_id, kind, term_id): terms (term_id, refs array) whose id or references are an event's ref."""
    named = terms.select("term_id", F.explode(F.array_distinct(F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.array("term_id")))).alias("ref"))
    return events.where(F.col("kind").isin(*KINDS)).join(named, "ref").select("event_id", "kind", "term_id")


def recertification_queue(touched: DataFrame) -> DataFrame:
    """Terms to certify anew, with the number of events that ask for it."""
    return touched.where("kind <> 'source_refreshed'").groupBy("term_id").agg(F.count(F.lit(1)).alias("events"))


def drift_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind and window; in a stream, events later than ``late`` are dropped with their window's state."""
    return events.withWatermark("at", late).groupBy(F.window("at", every), "kind").agg(F.count(F.lit(1)).alias("n")).select("window.start", "kind", "n")
