"""Match strategies of key columns: a registry of Column -> Column normalisers. Other types than strings pass unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import Refusal

#: Names of the strategies. casefold is Spark's lower(), which equals Python's casefold() for ASCII.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "exact": lambda c: c,
    "casefold": F.lower,
    "trimmed": lambda c: F.lower(F.trim(c)),
}


def register_strategy(name: str, normaliser: Callable[[Column], Column]) -> None:
    STRATEGIES[name] = normaliser


def normalised(c: Column, strategy: str, kind: str) -> Column:
    if strategy not in STRATEGIES:
        raise Refusal("unknown_match_strategy", strategy, strategies=sorted(STRATEGIES))
    return STRATEGIES[strategy](c) if kind == "string" else c
