"""The one exception callers see, with a stable code."""

from __future__ import annotations

CODES = (
    "invalid_identifier", "invalid_schema", "not_found", "already_exists", "bad_request", "type_mismatch",
    "unsupported", "permission_denied", "limit_exceeded", "storage_error", "corruption", "internal_error",
)


class EngineError(Exception):
    def __init__(self, code: str, message: str, kind: str = ""):
        assert code in CODES, code
        super().__init__(message)
        self.code, self.message, self.kind = code, message, kind

    def payload(self) -> dict:
        return {"error": {"code": self.code, "message": self.message}}


def bad_request(message: str) -> EngineError:
    return EngineError("bad_request", message)


def unsupported(message: str) -> EngineError:
    return EngineError("unsupported", message)


def not_found(kind: str, name: str) -> EngineError:
    return EngineError("not_found", f"{kind} {name!r} was not found", kind)


def mismatch(expected: str, actual: str) -> EngineError:
    return EngineError("type_mismatch", f"expected {expected}, got {actual}")
