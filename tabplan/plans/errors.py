"""Structured errors of the plan language."""

from __future__ import annotations


class PlanError(ValueError):
    """Where (path), what kind (code), what happened (message) and what helps (fix)."""

    def __init__(self, path: str, code: str, message: str, fix: str = ""):
        super().__init__(f"{path}: {code}: {message}")
        self.path, self.code, self.message, self.fix = path, code, message, fix

    def as_dict(self) -> dict[str, str]:
        return {"path": self.path, "code": self.code, "message": self.message, "fix": self.fix}
