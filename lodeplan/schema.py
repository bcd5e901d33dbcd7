"""Declared tables: types plus what the columns mean."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from . import types
from .errors import EngineError, not_found, unsupported

MAX_COLUMNS, MAX_PARTITIONS, DEFAULT_PARTITIONS = 512, 64, 4
AGGREGATIONS = ("count", "sum", "avg", "min", "max")
SEMANTICS = ("id", "currency", "timestamp", "category", "country", "email", "url", "quantity", "score", "text", "boolean", "json")
#: Adding these up means nothing.
NOT_MEASURES = {"id", "email", "url", "json"}
#: Equality on these is worth a membership filter.
LOOKED_UP = {"id", "category", "country", "email"}
_IDENTIFIER = re.compile(r"[a-z_][a-z0-9_-]{0,63}")


def identifier(kind: str, name: Any) -> str:
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise EngineError("invalid_identifier", f"invalid {kind} name {name!r}: up to 64 of a-z, 0-9, '_' and '-', not starting with a digit or '-'")
    return name


@dataclass(frozen=True)
class Column:
    name: str
    type: types.Type
    nullable: bool = True
    description: str | None = None
    semantic_type: str | None = None
    unit: str | None = None
    currency: str | None = None
    default_aggregation: str | None = None
    sensitive: bool = False
    references: tuple[str, str] | None = None

    @property
    def measure(self) -> bool:
        return self.semantic_type not in NOT_MEASURES

    @property
    def looked_up(self) -> bool:
        return self.semantic_type in LOOKED_UP or self.type is types.UUID

    def to_json(self) -> dict:
        out: dict[str, Any] = {"name": self.name, "type": self.type.name, "nullable": self.nullable}
        for key in ("description", "semantic_type", "unit", "currency", "default_aggregation"):
            if getattr(self, key) is not None:
                out[key] = getattr(self, key)
        out["sensitive"] = self.sensitive
        if self.references:
            out["references"] = dict(zip(("table", "column"), self.references))
        return out

    @staticmethod
    def from_json(spec: Any) -> Column:
        if not isinstance(spec, dict):
            raise EngineError("invalid_schema", f"a column must be an object, got {spec!r}")
        known = {"name", "type", "nullable", "description", "semantic_type", "unit", "currency", "default_aggregation", "sensitive", "references"}
        if extra := sorted(set(spec) - known):
            raise EngineError("invalid_schema", f"unknown column field {extra[0]!r}")
        agg, refers = spec.get("default_aggregation"), spec.get("references")
        if agg is not None and agg not in AGGREGATIONS:
            raise EngineError("invalid_schema", f"unknown aggregation {agg!r}")
        return Column(
            identifier("column", spec.get("name")), types.named(spec.get("type")), bool(spec.get("nullable", True)), spec.get("description"),
            spec.get("semantic_type"), spec.get("unit"), spec.get("currency"), agg, bool(spec.get("sensitive", False)),
            (refers["table"], refers["column"]) if refers else None,
        )


def fits(function: str, kind: types.Type) -> bool:
    """Whether an aggregate is defined for a type."""
    return function == "count" or (kind.numeric if function in ("sum", "avg") else kind.ordered)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    description: str | None = None
    partitions: int = DEFAULT_PARTITIONS
    version: int = 1
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._by_name.update({c.name: c for c in self.columns})

    def column(self, name: str) -> Column | None:
        return self._by_name.get(name)

    def require(self, name: str) -> Column:
        if name not in self._by_name:
            raise not_found("column", name)
        return self._by_name[name]

    def visible(self) -> list[str]:
        """What * stands for."""
        return [c.name for c in self.columns if not c.sensitive]

    def struct(self) -> T.StructType:
        """Nullable throughout, since older files lack newer columns; the rules live here and not in files."""
        return T.StructType([T.StructField(c.name, c.type.spark, True, {"type": c.type.name}) for c in self.columns])

    def check(self) -> Table:
        def wrong(message: str) -> EngineError:
            return EngineError("invalid_schema", message)

        identifier("table", self.name)
        if not self.columns:
            raise wrong("table must have at least one column")
        if len(self.columns) > MAX_COLUMNS:
            raise wrong(f"table may have at most {MAX_COLUMNS} columns")
        if not 1 <= self.partitions <= MAX_PARTITIONS:
            raise wrong(f"partitions must be between 1 and {MAX_PARTITIONS}, got {self.partitions}")
        for place, c in enumerate(self.columns):
            identifier("column", c.name)
            if any(c.name == other.name for other in self.columns[:place]):
                raise wrong(f"duplicate column {c.name!r}")
            if c.currency is not None and c.semantic_type != "currency":
                raise wrong(f"column {c.name!r} sets `currency` without semantic_type=currency")
            if c.default_aggregation and not fits(c.default_aggregation, c.type):
                raise wrong(f"column {c.name!r} of type {c.type} cannot default to aggregation {c.default_aggregation}")
        for place, key in enumerate(self.primary_key):
            c = self.column(key)
            if c is None:
                raise wrong(f"primary key column {key!r} is not defined")
            if key in self.primary_key[:place]:
                raise wrong(f"duplicate primary key column {key!r}")
            if c.nullable:
                raise wrong(f"primary key column {key!r} must be non-nullable")
            if c.type in (types.FLOAT64, types.JSON):
                raise wrong(f"primary key column {key!r} may not be of type {c.type}")
        return self

    def evolved(self, new: Table) -> Table:
        """new as the next version: nullable columns may come, meanings may change, nothing else."""
        new.check()
        if new.name != self.name:
            raise EngineError("invalid_schema", "table name cannot change")
        for what in ("primary_key", "partitions"):
            if getattr(new, what) != getattr(self, what):
                raise unsupported(f"changing the {'primary key' if what == 'primary_key' else 'partition count'}")
        for old in self.columns:
            c = new.column(old.name)
            if c is None:
                raise unsupported(f"dropping column {old.name!r}")
            if c.type is not old.type:
                raise unsupported(f"changing the type of column {old.name!r} ({old.type} -> {c.type})")
            if c.nullable != old.nullable:
                raise unsupported(f"changing nullability of column {old.name!r}")
        for c in new.columns:
            if self.column(c.name) is None and not c.nullable:
                raise EngineError("invalid_schema", f"added column {c.name!r} must be nullable")
        return replace(new, version=self.version + 1, _by_name={})

    def to_json(self) -> dict:
        out = {"name": self.name, "columns": [c.to_json() for c in self.columns], "primary_key": list(self.primary_key), "partitions": self.partitions, "version": self.version}
        return out | ({"description": self.description} if self.description is not None else {})

    @staticmethod
    def from_json(spec: dict) -> Table:
        columns = spec.get("columns")
        if not isinstance(columns, list):
            raise EngineError("invalid_schema", "a table needs an array \"columns\"")
        return Table(identifier("table", spec.get("name")), tuple(map(Column.from_json, columns)), tuple(spec.get("primary_key") or ()), spec.get("description"), spec.get("partitions") or DEFAULT_PARTITIONS, spec.get("version") or 1)

    def context(self) -> str:
        """The table described for a reader, without sensitive columns."""
        lines = [f"table {self.name}" + (f": {self.description}" if self.description else "")]
        if self.primary_key:
            lines.append(f"  primary key: {', '.join(self.primary_key)}")
        for c in self.columns:
            if c.sensitive:
                continue
            notes = [c.semantic_type, c.currency, c.unit, c.default_aggregation and f"aggregate with {c.default_aggregation}", c.references and f"references {'.'.join(c.references)}", None if c.nullable else "required"]
            notes = [n for n in notes if n]
            lines.append(f"  {c.name} {c.type}" + (f" [{', '.join(notes)}]" if notes else "") + (f": {c.description}" if c.description else ""))
        return "\n".join(lines) + "\n"
