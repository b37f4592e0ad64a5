"""Governed analytics on Apache Spark: contracts, metrics, search, federation and evidence."""
