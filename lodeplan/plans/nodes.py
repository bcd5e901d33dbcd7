"""The logical plan: seven kinds of node, each of which can check itself and print itself.

``bound(table, limits, warnings)`` returns the node with literals typed and limits clamped, and its
shape: an ordered dict from output names to (type, nullable).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import ClassVar

from .. import types
from ..context import Limits
from ..errors import EngineError, bad_request, mismatch, not_found, unsupported
from ..schema import Table, fits, identifier
from .expressions import Expr, Name

Output = dict[str, tuple[types.Type, bool]]


def _types(shape: Output) -> dict[str, types.Type]:
    return {name: kind for name, (kind, _) in shape.items()}


def _known(shape: Output, name: str) -> tuple[types.Type, bool]:
    if name not in shape:
        raise not_found("column", name)
    return shape[name]


@dataclass(frozen=True)
class Metric:
    function: str
    column: str | None = None
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or (f"{self.function}_{self.column}" if self.column else "count")

    def __str__(self) -> str:
        return f"{self.function}({self.column or '*'})"

    def bound(self, shape: Output, table: Table) -> tuple[Metric, tuple[types.Type, bool]]:
        named = replace(self, alias=identifier("column", self.name))
        if self.column is None:
            if self.function != "count":
                raise bad_request(f"{self.function} needs a column; only count can be applied to all rows")
            return named, (types.INT64, False)
        kind, _ = _known(shape, self.column)
        if not fits(self.function, kind):
            raise bad_request(f"{self.function}({self.column}) is not defined for type {kind}")
        declared = table.column(self.column)
        if self.function in ("sum", "avg") and declared and not declared.measure:
            raise bad_request(f"{self.function}({self.column}) is not meaningful: {self.column} is a {declared.semantic_type} column, not a measure")
        result = {"count": types.INT64, "avg": types.FLOAT64}.get(self.function, kind)
        return named, (result, self.function != "count")


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True
    nulls_first: bool = False

    def __str__(self) -> str:
        return f"{self.column} {'asc' if self.ascending else 'desc'}"


@dataclass(frozen=True)
class Node:
    kind: ClassVar[str]

    @property
    def below(self) -> Node | None:
        return getattr(self, "input", None)

    def line(self) -> str:
        raise NotImplementedError

    def explain(self, depth: int = 0) -> str:
        own = "  " * depth + self.line() + "\n"
        return own + (self.below.explain(depth + 1) if self.below else "")

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        raise NotImplementedError


@dataclass(frozen=True)
class Scan(Node):
    kind: ClassVar[str] = "scan"
    table: str
    columns: tuple[str, ...] | None = None

    def line(self) -> str:
        return f"scan {self.table} [{'*' if self.columns is None else ', '.join(self.columns)}]"

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        if self.table != table.name:
            raise EngineError("internal_error", f"plan scans {self.table} but was validated against {table.name}")
        if self.columns is not None and not self.columns:
            raise bad_request("scan requests zero columns")
        names = list(self.columns) if self.columns is not None else table.visible()
        shape: Output = {}
        for name in names:
            column = table.require(name)
            if name in shape:
                raise bad_request(f"column {name!r} is requested twice")
            shape[name] = (column.type, column.nullable)
        return Scan(self.table, tuple(names)), shape


@dataclass(frozen=True)
class Filter(Node):
    kind: ClassVar[str] = "filter"
    input: Node
    predicate: Expr

    def line(self) -> str:
        return f"filter {self.predicate}"

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        below, shape = self.input.bound(table, limits, warnings)
        predicate, kind = self.predicate.checked(_types(shape))
        if kind not in (None, types.BOOL):
            raise mismatch("a boolean filter", f"{kind} ({predicate})")
        return Filter(below, predicate), shape


@dataclass(frozen=True)
class Project(Node):
    kind: ClassVar[str] = "project"
    input: Node
    outputs: tuple[tuple[Expr, str], ...]

    def line(self) -> str:
        return "project " + ", ".join(alias if e == Name(alias) else f"{e} as {alias}" for e, alias in self.outputs)

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        below, shape = self.input.bound(table, limits, warnings)
        if not self.outputs:
            raise bad_request("projection selects no columns")
        out: Output = {}
        for expr, alias in self.outputs:
            if not isinstance(expr, Name):
                raise unsupported(f"computed projection ({expr}); project columns and aggregate instead")
            found = _known(shape, expr.name)
            if identifier("column", alias) in out:
                raise bad_request(f"output name {alias!r} is used twice")
            out[alias] = found
        return replace(self, input=below), out


@dataclass(frozen=True)
class Aggregate(Node):
    kind: ClassVar[str] = "aggregate"
    input: Node
    group_by: tuple[str, ...]
    metrics: tuple[Metric, ...]

    def line(self) -> str:
        return f"aggregate group_by=[{', '.join(self.group_by)}] " + ", ".join(f"{m} as {m.name}" for m in self.metrics)

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        below, shape = self.input.bound(table, limits, warnings)
        if not self.metrics:
            raise bad_request("aggregate needs at least one metric (try count)")
        out: Output = {}
        for key in self.group_by:
            kind, nullable = _known(shape, key)
            if not kind.ordered:
                raise bad_request(f"column {key!r} of type {kind} cannot be grouped")
            if key in out:
                raise bad_request(f"group key {key!r} is repeated")
            out[key] = (kind, nullable)
        metrics = []
        for metric in self.metrics:
            metric, result = metric.bound(shape, table)
            if metric.alias in out:
                raise bad_request(f"output name {metric.alias!r} is used twice")
            out[metric.alias] = result
            metrics.append(metric)
        return Aggregate(below, self.group_by, tuple(metrics)), out


@dataclass(frozen=True)
class Sort(Node):
    kind: ClassVar[str] = "sort"
    input: Node
    keys: tuple[SortKey, ...]

    def line(self) -> str:
        return "sort " + ", ".join(map(str, self.keys))

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        below, shape = self.input.bound(table, limits, warnings)
        if not self.keys:
            raise bad_request("sort needs at least one key")
        for key in self.keys:
            kind, _ = _known(shape, key.column)
            if not kind.ordered:
                raise bad_request(f"column {key.column!r} of type {kind} cannot be sorted")
        return replace(self, input=below), shape


@dataclass(frozen=True)
class Limit(Node):
    kind: ClassVar[str] = "limit"
    input: Node
    limit: int
    offset: int = 0

    def line(self) -> str:
        return f"limit {self.limit} offset {self.offset}"

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        below, shape = self.input.bound(table, limits, warnings)
        if self.limit > limits.max_rows:
            warnings.append(f"limit {self.limit} exceeds the {limits.max_rows} row budget for this request and was reduced")
        return Limit(below, min(self.limit, limits.max_rows), self.offset), shape


@dataclass(frozen=True)
class Join(Node):
    """Part of the language so that asking for one has a clear answer."""

    kind: ClassVar[str] = "join"
    left: Node
    right: Node
    condition: Expr

    @property
    def below(self) -> Node | None:
        return self.left

    def line(self) -> str:
        return f"join on {self.condition}"

    def explain(self, depth: int = 0) -> str:
        return "  " * depth + self.line() + "\n" + self.left.explain(depth + 1) + self.right.explain(depth + 1)

    def bound(self, table: Table, limits: Limits, warnings: list[str]) -> tuple[Node, Output]:
        raise unsupported("joins are not available: query one table at a time")


@dataclass(frozen=True)
class Bound:
    plan: Node
    shape: Output
    warnings: list[str]


def bind(plan: Node, table: Table, limits: Limits) -> Bound:
    warnings: list[str] = []
    checked, shape = plan.bound(table, limits, warnings)
    # a table of sensitive columns only still has a number of rows
    if not shape:
        raise bad_request("query selects no columns")
    return Bound(checked, shape, warnings)
