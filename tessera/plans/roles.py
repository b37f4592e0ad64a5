"""Field roles from descriptions: which field identifies a row, names it, holds its text, time or score."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

#: Words that speak for a role.
ROLE_WORDS: dict[str, tuple[str, ...]] = {
    "identity": ("unique identifier", "identifier for each", "primary key"),
    "display_name": ("display name", "title", "name of"),
    "body_text": ("body", "text", "comment", "prose", "content"),
    "timestamp": ("timestamp", "date", "time"),
    "score": ("score", "rating", "relevance"),
}


def _points(description: str, words: tuple[str, ...]) -> int:
    low = description.casefold()
    return sum(re.search(rf"\b{re.escape(w)}\b", low) is not None for w in words)


def field_roles(contract: Mapping[str, Any], words: Mapping[str, tuple[str, ...]] = ROLE_WORDS) -> dict[str, list[str]]:
    """Field -> roles: the role with most points, ahead of the next by one, and join_key where a relation uses the field."""
    out: dict[str, list[str]] = {}
    for k, f in {**contract["dimensions"], **contract["measures"]}.items():
        points = sorted(((_points(f["description"], w), role) for role, w in words.items()), key=lambda x: (-x[0], x[1]))
        roles = [points[0][1]] if points[0][0] >= 1 and points[0][0] - points[1][0] >= 1 else []
        if any(k in (r["left"], r["right"]) for r in contract["relations"]):
            roles.append("join_key")
        if roles:
            out[k] = roles
    return out


def columns_with(contract: Mapping[str, Any], table: str, *roles: str) -> list[str]:
    """Columns of the table that have one of the roles, in the order of the roles."""
    fields = {**contract["dimensions"], **contract["measures"]}
    return [fields[k]["column"] for role in roles for k, own in contract["field_roles"].items() if role in own and fields[k]["table"] == table]
