"""API keys: bearer tokens that stand for a tenant, scopes and limits."""

from __future__ import annotations

import hmac
from dataclasses import dataclass, field
from typing import Any

from ..context import READ_ONLY, SCOPES, Context, Limits
from ..errors import EngineError
from ..schema import identifier


@dataclass(frozen=True)
class Key:
    secret: str
    tenant: str
    name: str = "key"
    scopes: frozenset[str] = READ_ONLY
    database: str | None = None
    limits: Limits = field(default_factory=Limits)

    @staticmethod
    def from_json(spec: dict[str, Any]) -> Key:
        """Without scopes a key may only read."""
        scopes = frozenset(spec.get("scopes") or READ_ONLY)
        if unknown := sorted(scopes - set(SCOPES)):
            raise EngineError("bad_request", f"unknown scope {unknown[0]!r}")
        if not spec.get("key"):
            raise EngineError("bad_request", "an API key needs a \"key\"")
        database = spec.get("default_database")
        return Key(spec["key"], identifier("tenant", spec.get("tenant", "local")), spec.get("name", "key"), scopes, identifier("database", database) if database else None, Limits(**spec.get("limits", {})))

    def context(self) -> Context:
        return Context(self.tenant, self.database, self.name, self.scopes, self.limits)


class Keyring:
    def __init__(self, keys: list[Key] = (), local: Context | None = None):
        self.keys, self.local = list(keys), local

    def context(self, header: str | None) -> Context:
        """Of an Authorization header; every key is compared, in constant time each."""
        scheme, _, token = (header or "").strip().partition(" ")
        found = None
        for key in self.keys:
            if hmac.compare_digest(key.secret.encode(), token.strip().encode()):
                found = key
        if scheme.lower() != "bearer" or found is None:
            raise EngineError("permission_denied", "a valid API key is needed: Authorization: Bearer <key>")
        return found.context()

    def session(self) -> Context:
        """Of a local session, which needs no key: the only key's rights, or those given."""
        if self.local is not None:
            return self.local
        if len(self.keys) == 1:
            return self.keys[0].context()
        raise EngineError("permission_denied", "a local session needs one configured key" if self.keys else "no key is configured")
