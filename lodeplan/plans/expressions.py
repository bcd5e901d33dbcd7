"""Predicates.  Every node knows its type against a shape, its text, and its Spark column.

``checked(shape)`` returns the node with literals turned into values of the type they face, and that
type (None for a bare NULL).  A shape maps output names to types.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from .. import types
from ..errors import bad_request, mismatch, not_found
from ..functions import scalars

Shape = dict[str, types.Type]
Checked = tuple["Expr", types.Type | None]


class Expr:
    def checked(self, shape: Shape) -> Checked:
        raise NotImplementedError

    def spark(self) -> SparkColumn:
        raise NotImplementedError

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts()))

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return self

    def __and__(self, other: Expr) -> Expr:
        return Binary("and", self, other)

    def __or__(self, other: Expr) -> Expr:
        return Binary("or", self, other)

    def conjuncts(self) -> Iterator[Expr]:
        yield self


def all_of(parts: list[Expr]) -> Expr | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def _boolean(node: Checked) -> Expr:
    expr, kind = node
    if kind not in (None, types.BOOL):
        raise mismatch("bool", f"{kind} ({expr})")
    return expr


@dataclass(frozen=True)
class Name(Expr):
    name: str

    def checked(self, shape: Shape) -> Checked:
        if self.name not in shape:
            raise not_found("column", self.name)
        return self, shape[self.name]

    def spark(self) -> SparkColumn:
        return F.col(f"`{self.name}`")

    def columns(self) -> set[str]:
        return {self.name}

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return Name(names(self.name))

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Value(Expr):
    value: Any
    type: types.Type | None = None

    def checked(self, shape: Shape) -> Checked:
        return self, self.type or types.type_of(self.value)

    def facing(self, kind: types.Type) -> Value:
        return Value(types.literal(kind, self.value), kind)

    def spark(self) -> SparkColumn:
        kind = self.type or types.type_of(self.value)
        return F.lit(self.value) if kind is None else F.lit(self.value).cast(kind.spark)

    def __str__(self) -> str:
        return types.show(self.value)


_COMPARE: dict[str, Callable[[SparkColumn, SparkColumn], SparkColumn]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_LOGIC = {"and": lambda a, b: a & b, "or": lambda a, b: a | b}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": None}


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    #: Of the operands' arithmetic, once checked.
    type: types.Type | None = None

    def parts(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return replace(self, left=self.left.renamed(names), right=self.right.renamed(names))

    def conjuncts(self) -> Iterator[Expr]:
        if self.op != "and":
            yield self
        else:
            for part in self.parts():
                yield from part.conjuncts()

    def checked(self, shape: Shape) -> Checked:
        (left, lt), (right, rt) = self.left.checked(shape), self.right.checked(shape)
        if self.op in _LOGIC:
            return Binary(self.op, _boolean((left, lt)), _boolean((right, rt))), types.BOOL
        if self.op == "like":
            if lt not in (None, types.UTF8, types.UUID):
                raise mismatch("text on the left of `like`", f"{lt} ({left})")
            if not (isinstance(right, Value) and isinstance(right.value, str)):
                raise bad_request("`like` needs a string pattern on the right")
            return Binary("like", left, right), types.BOOL
        if lt and isinstance(right, Value):
            right, rt = right.facing(lt), lt
        elif rt and isinstance(left, Value):
            left, lt = left.facing(rt), rt
        if self.op in _ARITHMETIC:
            for kind, side in ((lt, left), (rt, right)):
                if kind is None:
                    raise bad_request(f"cannot infer the type of {side}")
            if not (lt.numeric and rt.numeric):
                raise mismatch("numeric operands", f"{lt} {self.op} {rt}")
            result = types.FLOAT64 if types.FLOAT64 in (lt, rt) else types.INT64
            return Binary(self.op, left, right, result), result
        if lt and rt:
            if lt is not rt and not (lt.numeric and rt.numeric):
                raise mismatch(f"a value comparable with {lt}", f"{rt} ({right})")
            if not lt.ordered and self.op not in ("=", "!="):
                raise bad_request(f"type {lt} supports only = and !=, not {self.op}")
        return Binary(self.op, left, right), types.BOOL

    def spark(self) -> SparkColumn:
        a, b = self.left.spark(), self.right.spark()
        if self.op == "like":
            return a.like(scalars.like_pattern(self.right.value))
        if self.op == "/":
            return scalars.divide(a, b, self.type is types.INT64)
        return (_COMPARE.get(self.op) or _LOGIC.get(self.op) or _ARITHMETIC[self.op])(a, b)

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Not(Expr):
    of: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return Not(self.of.renamed(names))

    def checked(self, shape: Shape) -> Checked:
        return Not(_boolean(self.of.checked(shape))), types.BOOL

    def spark(self) -> SparkColumn:
        return ~self.of.spark()

    def __str__(self) -> str:
        return f"not({self.of})"


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool = False

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return replace(self, of=self.of.renamed(names))

    def checked(self, shape: Shape) -> Checked:
        return replace(self, of=self.of.checked(shape)[0]), types.BOOL

    def spark(self) -> SparkColumn:
        return self.of.spark().isNotNull() if self.negated else self.of.spark().isNull()

    def __str__(self) -> str:
        return f"{self.of} is {'not ' if self.negated else ''}null"


@dataclass(frozen=True)
class OneOf(Expr):
    of: Expr
    values: tuple[Any, ...]
    negated: bool = False
    type: types.Type | None = None

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return replace(self, of=self.of.renamed(names))

    def checked(self, shape: Shape) -> Checked:
        of, kind = self.of.checked(shape)
        if not self.values:
            raise bad_request("`in` needs at least one value")
        values = tuple(types.literal(kind, v) for v in self.values) if kind else self.values
        return replace(self, of=of, values=values, type=kind), types.BOOL

    def spark(self) -> SparkColumn:
        found = self.of.spark().isin([Value(v, self.type).spark() for v in self.values])
        return ~found if self.negated else found

    def __str__(self) -> str:
        return f"{self.of} {'not ' if self.negated else ''}in ({', '.join(map(types.show, self.values))})"


@dataclass(frozen=True)
class Between(Expr):
    of: Expr
    low: Any
    high: Any
    negated: bool = False
    type: types.Type | None = None

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def renamed(self, names: Callable[[str], str]) -> Expr:
        return replace(self, of=self.of.renamed(names))

    def checked(self, shape: Shape) -> Checked:
        of, kind = self.of.checked(shape)
        low, high = (types.literal(kind, v) if kind else v for v in (self.low, self.high))
        if types.ordering(low) > types.ordering(high):
            raise bad_request(f"`between {types.show(low)} and {types.show(high)}` can never match: the bounds are reversed")
        return replace(self, of=of, low=low, high=high, type=kind), types.BOOL

    def spark(self) -> SparkColumn:
        found = self.of.spark().between(Value(self.low, self.type).spark(), Value(self.high, self.type).spark())
        return ~found if self.negated else found

    def __str__(self) -> str:
        return f"{self.of} {'not ' if self.negated else ''}between {types.show(self.low)} and {types.show(self.high)}"
