"""Who asks, what for, and how much they may use."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from .errors import EngineError

SCOPES = ("database:read", "database:write", "schema:read", "schema:write", "data:insert", "data:update", "data:delete")
READ_ONLY = frozenset({"database:read", "schema:read"})


@dataclass(frozen=True)
class Limits:
    max_rows: int = 10_000
    max_bytes_scanned: int = 4 << 30
    max_execution_time_ms: int = 30_000
    max_write_rows: int = 1_000_000

    def within(self, other: Limits) -> Limits:
        return Limits(*(min(a, b) for a, b in zip(self.values(), other.values())))

    def values(self) -> tuple[int, int, int, int]:
        return (self.max_rows, self.max_bytes_scanned, self.max_execution_time_ms, self.max_write_rows)


@dataclass(frozen=True)
class Context:
    tenant: str = "local"
    database: str | None = None
    user: str = "local"
    scopes: frozenset[str] = frozenset(SCOPES)
    limits: Limits = field(default_factory=Limits)
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def require(self, scope: str) -> None:
        if scope not in self.scopes:
            raise EngineError("permission_denied", f"this key lacks the scope {scope}")

    def into(self, database: str | None) -> Context:
        return replace(self, database=database)

    def limited(self, limits: Limits) -> Context:
        return replace(self, limits=limits.within(self.limits))
