"""The one shape that runs: scan, filter, aggregate, rename, sort, limit.

Spark would run any order of nodes; this engine refuses what its pipeline can't say, so that an answer
always means what its printed plan says.  ``flatten`` walks a bound plan from the scan upwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import not_found, unsupported
from . import nodes, prune
from .expressions import Expr

_STAGES = ("scan", "filter", "aggregate", "rename", "sort", "limit")


@dataclass
class Pipeline:
    table: str = ""
    available: tuple[str, ...] = ()
    filter: Expr | None = None
    group_by: tuple[str, ...] = ()
    metrics: tuple[nodes.Metric, ...] = ()
    renames: dict[str, str] | None = None  #: output name to scanned name
    sort: tuple[nodes.SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    #: Limits inside another limit, innermost first; nothing else stands between them.
    slices: list[tuple[int, int]] = field(default_factory=list)
    output: nodes.Output = field(default_factory=dict)

    @property
    def atoms(self) -> list[prune.Atom]:
        return prune.atoms(self.filter)

    @property
    def columns(self) -> list[str]:
        """What the scan has to read, in its order."""
        needed = set(self.filter.columns()) if self.filter else set()
        if self.metrics:
            needed |= {*self.group_by, *(m.column for m in self.metrics if m.column)}
        else:
            needed |= set(self.renames.values() if self.renames is not None else self.available)
        return [c for c in self.available if c in needed] or list(self.available[:1])

    @property
    def only_counts(self) -> bool:
        """Whether the number of rows answers all of it."""
        return len(self.metrics) == 1 and str(self.metrics[0]) == "count(*)" and not self.group_by and self.filter is None

    def explain(self) -> str:
        lines = [f"scan {self.table} [{', '.join(self.columns)}]"]
        if self.atoms:
            lines.append("  prune: " + " and ".join(map(str, self.atoms)))
        if self.filter is not None:
            lines.append(f"  filter: {self.filter}")
        if self.metrics:
            lines.append(f"  aggregate: group_by=[{', '.join(self.group_by)}] " + ", ".join(map(str, self.metrics)))
        if self.sort:
            lines.append("  sort: " + ", ".join(map(str, self.sort)))
        if self.limit is not None:
            lines.append(f"  limit: {self.limit} offset {self.offset}")
        return "\n".join(lines)


def flatten(bound: nodes.Bound) -> Pipeline:
    chain: list[nodes.Node] = []
    node: nodes.Node | None = bound.plan
    while node is not None:
        if isinstance(node, nodes.Join):
            raise unsupported("joins are not available: query one table at a time")
        chain.append(node)
        node = node.below
    out, reached = Pipeline(output=bound.shape), 0
    for node in reversed(chain):
        stage = "rename" if node.kind == "project" else node.kind
        place = _STAGES.index(stage)
        if place < reached and not _may_step_back(out, _STAGES[reached], stage):
            raise unsupported(f"{stage} after {_STAGES[reached]} is not executable")
        reached = max(reached, place)
        _ADD[type(node)](out, node)
    if out.sort and out.renames is not None and not out.metrics:
        for key in out.sort:
            if key.column not in out.renames:
                raise unsupported(f"sorting by {key.column!r}, which the projection removes")
    return out


def _may_step_back(out: Pipeline, reached: str, stage: str) -> bool:
    """A projection only renames, so a filter above it can go below; an aggregate can, if nothing got a new name."""
    return reached == "rename" and (stage == "aggregate" or stage == "filter" and not out.metrics)


def _scan(out: Pipeline, node: nodes.Scan) -> None:
    out.table, out.available = node.table, node.columns or ()


def _filter(out: Pipeline, node: nodes.Filter) -> None:
    names = out.renames

    def source(name: str) -> str:
        if names is None:
            return name
        if name not in names:
            raise not_found("column", name)
        return names[name]

    predicate = node.predicate.renamed(source)
    out.filter = predicate if out.filter is None else out.filter & predicate


def _aggregate(out: Pipeline, node: nodes.Aggregate) -> None:
    if out.metrics:
        raise unsupported("two aggregations in one plan")
    if out.renames is not None and any(a != b for a, b in out.renames.items()):
        raise unsupported("renaming columns before aggregating")
    out.renames, out.group_by, out.metrics = None, node.group_by, node.metrics


def _project(out: Pipeline, node: nodes.Project) -> None:
    before = out.renames or {}
    out.renames = {alias: before.get(e.name, e.name) for e, alias in node.outputs}


def _sort(out: Pipeline, node: nodes.Sort) -> None:
    if out.sort:
        raise unsupported("two sorts in one plan")
    out.sort = node.keys


def _limit(out: Pipeline, node: nodes.Limit) -> None:
    """A limit over a limit takes its slice of that slice."""
    out.slices.append((node.limit, node.offset))
    if out.limit is None:
        out.limit, out.offset = node.limit, node.offset
    else:
        out.limit, out.offset = max(0, min(out.limit - node.offset, node.limit)), out.offset + node.offset


_ADD = {nodes.Scan: _scan, nodes.Filter: _filter, nodes.Aggregate: _aggregate, nodes.Project: _project, nodes.Sort: _sort, nodes.Limit: _limit}
