"""Which files a filter can't match, from the statistics kept beside them.

Only conditions that every row must meet count: comparisons of a column with a value, joined by and.
Skipping errs on one side; the filter itself is always applied to what is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .. import types
from .expressions import Between, Binary, Expr, IsNull, Name, OneOf, Value

_MIRROR = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Atom:
    column: str
    op: str
    values: tuple[Any, ...] = ()

    def __str__(self) -> str:
        return f"{self.column} {self.op}" + (f" [{', '.join(map(types.show, self.values))}]" if self.values else "")

    def excludes(self, rows: int, stats: dict | None) -> bool:
        """stats: min, max, nulls of the column in one file; without them nothing is known."""
        if stats is None:
            return False
        nulls, low, high = stats.get("nulls"), stats.get("min"), stats.get("max")
        if self.op == "is null":
            return nulls == 0
        if nulls == rows:
            return True  # no other condition holds for null
        if self.op == "is not null" or low is None or high is None:
            return False
        a, b = types.ordering(low), types.ordering(high)
        wanted = [types.ordering(v) for v in self.values if v is not None]
        if self.op in ("=", "in"):
            return not any(a <= v <= b for v in wanted)
        v = wanted[0]
        return {"<": a >= v, "<=": a > v, ">": b <= v, ">=": b < v}[self.op]


def _of(part: Expr) -> list[Atom]:
    if isinstance(part, IsNull) and isinstance(part.of, Name):
        return [Atom(part.of.name, "is not null" if part.negated else "is null")]
    if isinstance(part, OneOf) and isinstance(part.of, Name) and not part.negated:
        return [Atom(part.of.name, "in", part.values)]
    if isinstance(part, Between) and isinstance(part.of, Name) and not part.negated:
        return [Atom(part.of.name, op, (v,)) for op, v in ((">=", part.low), ("<=", part.high)) if v is not None]
    if isinstance(part, Binary) and part.op in _MIRROR:
        for op, a, b in ((part.op, part.left, part.right), (_MIRROR[part.op], part.right, part.left)):
            if isinstance(a, Name) and isinstance(b, Value) and b.value is not None:
                return [Atom(a.name, op, (b.value,))]
    return []


def atoms(predicate: Expr | None) -> list[Atom]:
    return [a for part in predicate.conjuncts() for a in _of(part)] if predicate is not None else []


def excluded(found: list[Atom], rows: int, stats: dict[str, dict]) -> bool:
    return any(a.excludes(rows, stats.get(a.column)) for a in found)
