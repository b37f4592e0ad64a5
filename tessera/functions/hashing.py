"""Content ids: the same content has the same id on the driver and in a DataFrame."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False)


def digest(value: Any, length: int = 16) -> str:
    return hashlib.sha256((value if isinstance(value, str) else canonical(value)).encode()).hexdigest()[:length]


def content_id(prefix: str, value: Any, length: int = 16) -> str:
    return f"{prefix}{digest(value, length)}"


def row_id(prefix: str, *cols: Column, length: int = 16) -> Column:
    """Id of a row's values: SHA-256 of their strings with separators; null differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length))
