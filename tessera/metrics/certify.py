"""Certification: a metric keeps its certificate while its definition and its golden answers hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tessera.metrics.kernel import Kernel, Metric


def certify(kernel: Kernel, run: Callable[[Metric, Mapping[str, Any]], DataFrame], metric_id: str, golden: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """Certificate of a metric. golden: {request, expected}; the first row must have the expected values."""
    m = kernel.metrics[metric_id]
    failed = []
    for k, g in enumerate(golden):
        row = run(m, g.get("request", {})).first()
        got = row.asDict() if row else {}
        if any(got.get(c) != v for c, v in g["expected"].items()):
            failed.append({"question": k, "expected": dict(g["expected"]), "got": got})
    return {"metric_id": metric_id, "definition_hash": m.definition_hash, "passed": not failed, "failures": failed}


def stale(kernel: Kernel, certificates: Sequence[Mapping[str, Any]]) -> frozenset[str]:
    """Metrics whose certificate failed or is for another definition."""
    return frozenset(c["metric_id"] for c in certificates if not c["passed"] or c["metric_id"] not in kernel.metrics or kernel.metrics[c["metric_id"]].definition_hash != c["definition_hash"])
