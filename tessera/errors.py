"""Refusals and issues: requests outside the contract get a typed answer, never a guess."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Refusal(Exception):
    """A request that the contract doesn't allow. ``code`` is stable and meant for programs."""

    def __init__(self, code: str, detail: str = "", **more: Any):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail, self.more = code, detail, more

    def as_dict(self) -> dict[str, Any]:
        return {"status": "refused", "reason_code": self.code, "detail": self.detail, **self.more}


@dataclass(frozen=True)
class Issue:
    """A finding about declared inputs. Errors make a contract invalid, warnings don't."""

    code: str
    where: str
    detail: str
    severity: str = "error"

    @property
    def is_error(self) -> bool:
        return self.severity == "error"


@dataclass
class Clarify(Exception):
    """A request with several readings; ``options`` are the ones to choose from."""

    code: str
    detail: str
    options: list[str] = field(default_factory=list)

    def as_dict(self) -> dict[str, Any]:
        return {"status": "clarify", "reason_code": self.code, "detail": self.detail, "options": self.options}
