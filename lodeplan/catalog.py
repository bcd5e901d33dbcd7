"""Tenants, databases and tables: an immutable snapshot, changed by mutations that a log keeps in order."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from .errors import EngineError, bad_request, not_found
from .schema import Table, identifier
from .sources.files import Log

Databases = dict[str, dict[str, dict]]


@dataclass(frozen=True)
class Snapshot:
    """(tenant, database) to its tables; a table is its schema and, for foreign Parquet, the path."""

    databases: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))
    epoch: int = 0

    def tables(self, tenant: str, database: str) -> dict[str, tuple[Table, str | None]]:
        if (tenant, database) not in self.databases:
            raise not_found("database", database)
        return self.databases[tenant, database]

    def names(self, tenant: str) -> list[str]:
        return sorted(d for t, d in self.databases if t == tenant)

    def table(self, tenant: str, database: str, name: str) -> tuple[Table, str | None]:
        tables = self.tables(tenant, database)
        if name not in tables:
            raise not_found("table", name)
        return tables[name]

    def apply(self, change: dict[str, Any]) -> Snapshot:
        """A pure function of snapshot and change; what can't be applied raises and changes nothing."""
        kind, tenant, database = change["kind"], change["tenant"], change["database"]
        all_of = dict(self.databases)
        if kind == "create_database":
            if (tenant, identifier("database", database)) in all_of:
                raise EngineError("already_exists", f"database {database!r} already exists")
            all_of[tenant, database] = MappingProxyType({})
        elif kind == "drop_database":
            if self.tables(tenant, database) and not change.get("cascade"):
                raise bad_request(f"database {database!r} is not empty; pass cascade to drop its tables too")
            del all_of[tenant, database]
        else:
            tables = dict(self.tables(tenant, database))
            if kind == "drop_table":
                self.table(tenant, database, change["table"])
                del tables[change["table"]]
            else:
                new = Table.from_json(change["schema"]).check()
                if kind == "create_table":
                    if new.name in tables:
                        raise EngineError("already_exists", f"table {new.name!r} already exists")
                    tables[new.name] = (new, change.get("path"))
                else:
                    old, path = self.table(tenant, database, new.name)
                    tables[new.name] = (old.evolved(new), path)
            all_of[tenant, database] = MappingProxyType(tables)
        return Snapshot(MappingProxyType(all_of), self.epoch + 1)


class Catalog:
    def __init__(self, log: Log):
        self.log, self.now = log, Snapshot()
        self.refresh()

    def refresh(self) -> None:
        for number in sorted(n for n in self.log.numbers() if n > self.now.epoch):
            if number != self.now.epoch + 1:
                raise EngineError("corruption", f"the catalog log lacks entry {self.now.epoch + 1}")
            self.now = self.now.apply(self.log.entry(number))

    def change(self, **change: Any) -> Snapshot:
        """Check first, then log, then show."""
        after = self.now.apply(change)
        self.log.append(after.epoch, change)
        self.now = after
        return after
