"""The structured plan that callers send, and what it lowers to."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .. import types
from ..errors import bad_request
from ..schema import AGGREGATIONS, identifier
from . import nodes
from .expressions import Between, Binary, Expr, IsNull, Name, OneOf, Value, all_of

_SYMBOLS = {"eq": "=", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "like": "like"}
OPERATORS = (*_SYMBOLS, "in", "not_in", "between", "is_null", "is_not_null")


@dataclass
class FilterSpec:
    column: str
    op: str
    value: Any = None
    values: list = field(default_factory=list)
    has_value: bool = True

    def expr(self) -> Expr:
        column = Name(self.column)
        if self.op in _SYMBOLS:
            if not self.has_value:
                raise bad_request(f'filter on {self.column!r} with op {self.op} needs a "value"')
            return Binary(_SYMBOLS[self.op], column, Value(types.scalar(self.value)))
        if self.op in ("is_null", "is_not_null"):
            return IsNull(column, self.op == "is_not_null")
        if self.op == "between":
            if len(self.values) != 2:
                raise bad_request(f'filter on {self.column!r} with op between needs exactly two "values"')
            return Between(column, *map(types.scalar, self.values))
        if not self.values:
            raise bad_request(f'filter on {self.column!r} with op {self.op} needs "values"')
        return OneOf(column, tuple(map(types.scalar, self.values)), self.op == "not_in")

    def to_json(self) -> dict:
        out: dict = {"column": self.column, "op": self.op}
        if self.op in _SYMBOLS:
            out["value"] = self.value
        return out | ({"values": self.values} if self.values else {})


#: For each object of a plan: field, whether required, and the JSON type(s) it takes.
_PLAN = {"operation": str, "table": str, "columns": list, "filters": list, "group_by": list, "metrics": list, "order_by": list, "limit": int, "offset": int}
_FILTER = {"column": str, "op": str, "value": object, "values": list}
_METRIC = {"function": str, "column": str, "alias": str}
_ORDER = {"column": str, "direction": str}


def _fields(spec: Any, known: dict, required: tuple[str, ...], what: str) -> dict:
    if not isinstance(spec, dict):
        raise bad_request(f"{what} must be an object")
    for key, value in spec.items():
        if key not in known:
            raise bad_request(f"{what} has no field {key!r}")
        if value is not None and (not isinstance(value, known[key]) or known[key] is int and (isinstance(value, bool) or value < 0)):
            raise bad_request(f"{what}: {key!r} is not usable: {value!r}")
    for key in required:
        if spec.get(key) is None:
            raise bad_request(f"{what} needs {key!r}")
    return spec


def _one_of(value: str, among: tuple[str, ...], what: str) -> str:
    if value not in among:
        raise bad_request(f"unknown {what} {value!r}; one of {', '.join(among)}")
    return value


def _names(values: list, what: str) -> list[str]:
    if not all(isinstance(v, str) for v in values):
        raise bad_request(f"{what} must be names")
    return values


@dataclass
class Plan:
    table: str
    operation: str = "select"
    columns: list[str] | None = None
    filters: list[FilterSpec] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    metrics: list[nodes.Metric] = field(default_factory=list)
    order_by: list[nodes.SortKey] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None

    @staticmethod
    def from_json(spec: Any) -> Plan:
        s = _fields(spec, _PLAN, ("table",), "a plan")
        filters, metrics, orders = [], [], []
        for f in s.get("filters") or []:
            _fields(f, _FILTER, ("column", "op"), "a filter")
            filters.append(FilterSpec(f["column"], _one_of(f["op"], OPERATORS, "filter op"), f.get("value"), f.get("values") or [], "value" in f))
        for m in s.get("metrics") or []:
            _fields(m, _METRIC, ("function",), "a metric")
            metrics.append(nodes.Metric(_one_of(m["function"], AGGREGATIONS, "aggregate function"), m.get("column"), m.get("alias") or ""))
        for o in s.get("order_by") or []:
            _fields(o, _ORDER, ("column",), "an order")
            orders.append(nodes.SortKey(o["column"], _one_of(o.get("direction") or "asc", ("asc", "desc"), "direction") == "asc"))
        columns = s.get("columns")
        return Plan(s["table"], _one_of(s.get("operation") or "select", ("select", "aggregate"), "operation"), None if columns is None else _names(columns, "columns"), filters, _names(s.get("group_by") or [], "group_by"), metrics, orders, s.get("limit"), s.get("offset"))

    def to_json(self) -> dict:
        out: dict = {"operation": self.operation, "table": self.table}
        parts = {
            "columns": self.columns, "filters": [f.to_json() for f in self.filters], "group_by": self.group_by,
            "metrics": [{"function": m.function} | ({"column": m.column} if m.column else {}) | ({"alias": m.alias} if m.alias else {}) for m in self.metrics],
            "order_by": [{"column": k.column, "direction": "asc" if k.ascending else "desc"} for k in self.order_by],
        }
        out |= {k: v for k, v in parts.items() if v}
        return out | {k: v for k in ("limit", "offset") if (v := getattr(self, k)) is not None}

    def logical(self) -> nodes.Node:
        identifier("table", self.table)
        predicate = all_of([f.expr() for f in self.filters])
        wanted = tuple(self.columns or ()) if self.operation == "select" else ()
        # a column that only the filter needs is read and projected away again
        unseen = tuple(sorted(predicate.columns() - set(wanted))) if wanted and predicate is not None else ()
        node: nodes.Node = nodes.Scan(self.table, wanted + unseen if wanted else None)
        if predicate is not None:
            node = nodes.Filter(node, predicate)
        if unseen:
            node = nodes.Project(node, tuple((Name(c), c) for c in wanted))
        if self.operation == "aggregate":
            if not self.metrics:
                raise bad_request('an aggregate needs at least one metric, e.g. {"function":"count"}')
            node = nodes.Aggregate(node, tuple(self.group_by), tuple(self.metrics))
        elif self.metrics or self.group_by:
            raise bad_request('metrics and group_by need "operation": "aggregate"')
        if self.order_by:
            node = nodes.Sort(node, tuple(self.order_by))
        if self.limit is not None:
            return nodes.Limit(node, self.limit, self.offset or 0)
        if self.offset:
            raise bad_request(f"offset {self.offset} needs a limit as well")
        return node


def json_schema() -> dict:
    """The plan as JSON Schema, for tool descriptions."""
    text, names = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    count = {"type": "integer", "minimum": 0}

    def closed(properties: dict, *required: str) -> dict:
        return {"type": "object", "additionalProperties": False, "required": list(required), "properties": properties}

    return closed({
        "operation": {"type": "string", "enum": ["select", "aggregate"], "default": "select"}, "table": text, "columns": names,
        "filters": {"type": "array", "items": closed({"column": text, "op": {"type": "string", "enum": list(OPERATORS)}, "value": {}, "values": {"type": "array", "items": {}}}, "column", "op")},
        "group_by": names,
        "metrics": {"type": "array", "items": closed({"function": {"type": "string", "enum": list(AGGREGATIONS)}, "column": text, "alias": text}, "function")},
        "order_by": {"type": "array", "items": closed({"column": text, "direction": {"type": "string", "enum": ["asc", "desc"]}}, "column")},
        "limit": count, "offset": count,
    }, "table")


__all__ = ["FilterSpec", "OPERATORS", "Plan", "json_schema"]
