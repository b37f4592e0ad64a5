"""Certified metrics: kernel, resolution, join paths, formulas, time, freshness, lineage, certification."""
