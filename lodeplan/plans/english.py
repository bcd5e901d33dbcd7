"""English questions to structured plans, by rules alone.

A question is a list of words, each of which one rule may claim.  The rules run in a fixed order over
the words nobody has claimed; what they recognise becomes parts of a plan, and a note that says how the
words were read.  A question with nothing recognisable, or about two tables, is refused.  The same
question over the same tables at the same time gives the same plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from .. import types
from ..errors import EngineError, bad_request, unsupported
from ..schema import Column, Table, fits
from . import nodes
from .request import FilterSpec, Plan

# The vocabulary.
STOPWORDS = {"the", "of", "a", "an", "all", "each", "every", "me", "my", "our", "their", "in", "for", "with", "and", "that", "which", "was"}
BEFORE_VERBS = {"is", "are", "was", "were", "be", "been", "the", "a", "an", "of", "="}
LISTING = {"show", "list", "find", "get", "select", "fetch", "display", "give"}
ASKING = {"which", "what", "who"}
MISSING_ELSEWHERE = ("haven", "hasn", "didn", "never", "without")
RELATIVE = {"last", "past", "previous", "this", "recent"}
ABSOLUTE = {"since": "gte", "from": "gte", "after": "gt", "before": "lt", "until": "lt"}
COMPARISONS = {("greater", "than"): "gt", ("more", "than"): "gt", ("less", "than"): "lt", ("fewer", "than"): "lt", ("at", "least"): "gte", ("at", "most"): "lte", ("over",): "gt", ("under",): "lt"}
EQUALS = {"is", "equals", "=", "=="}
SMALLEST, LARGEST, ANY = {"bottom", "lowest", "smallest", "cheapest"}, {"top", "highest", "largest", "biggest", "best"}, {"first", "limit", "any"}
FUNCTIONS = {"total": "sum", "sum": "sum", "summed": "sum", "revenue": "sum", "spend": "sum", "average": "avg", "avg": "avg", "mean": "avg", "minimum": "min", "min": "min", "earliest": "min", "maximum": "max", "max": "max", "latest": "max"}
SYNONYMS = {
    "currency": ("revenue", "sales", "amount", "spend", "value", "money", "price", "cost"),
    "country": ("country", "market", "region", "nation"),
    "timestamp": ("date", "time", "when", "day", "timestamp"),
    "category": ("category", "kind", "type", "segment", "status"),
    "email": ("email", "e-mail"),
}
SPANS = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7), "month": timedelta(days=30), "quarter": timedelta(days=91), "year": timedelta(days=365)}
RANKED = 10

_MEANING = {word: meaning for meaning, words in SYNONYMS.items() for word in words}
_WHOLE = re.compile(r"[+-]?\d+")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")


def words_of(text: str) -> list[str]:
    return [w for part in re.split(r"[\s()?!;:]+", text.lower()) if (w := part.strip("\"'.`,"))]


def number(word: str) -> int | float | None:
    bare = re.sub("[,$]", "", word)
    if _WHOLE.fullmatch(bare) and types.INT_MIN <= int(bare) <= types.INT_MAX:
        return int(bare)
    return float(bare) if _NUMBER.fullmatch(bare) else None


def singular(word: str) -> str:
    if word.endswith("ies"):
        return word[:-3] + "y"
    if re.search("(s|x|z|ch|sh)es$", word):
        return word[:-2]
    return word.removesuffix("s")


def called(word: str, table: str) -> bool:
    w = word.replace("-", "_")
    return w == table or w.rstrip("s") == table.rstrip("s") or w.replace("_", "") == table.replace("_", "")


def main_time(table: Table) -> Column | None:
    found = [c for c in table.columns if c.type in (types.TIMESTAMP, types.DATE)]
    if len(found) == 1:
        return found[0]
    return next((c for c in found if c.semantic_type == "timestamp"), None) or next((c for c in found if "created" in c.name), None)


def resolve(table: Table, phrase: str) -> Column | None:
    """The column that a phrase names: by name, by a looser form of it, by meaning, by its beginning, by description."""
    phrase = phrase.strip()
    if not phrase:
        return None
    name = re.sub("[ -]", "_", phrase)
    flat = name.replace("_", "")
    if found := table.column(name):
        return found
    for c in table.columns:
        own = c.name.replace("_", "")
        if own == flat or singular(c.name) == singular(name) or singular(own) == singular(flat):
            return c
    meaning = _MEANING.get(phrase)
    if meaning:
        alike = [c for c in table.columns if c.semantic_type == meaning]
        if len(alike) == 1:
            return alike[0]
        if meaning == "timestamp":
            return main_time(table)
    for fitting in (
        [c for c in table.columns if c.name.startswith(name)] if len(name) >= 4 else [],
        [c for c in table.columns if phrase in (c.description or "").lower()],
    ):
        if len(fitting) == 1:
            return fitting[0]
    return None


def calendar(unit: str, back: int, now: datetime) -> tuple[datetime, datetime] | None:
    """The calendar unit that now is in, or the one before; months count on from year 0."""
    unit = unit.rstrip("s")
    day = now.astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    if unit in ("day", "today", "week"):
        length = timedelta(days=7 if unit == "week" else 1)
        start = day - timedelta(days=day.weekday() if unit == "week" else 0) - back * length
        return start, start + length
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        return None
    first = ((day.year * 12 + day.month - 1) // months - back) * months
    return tuple(datetime(m // 12, m % 12 + 1, 1, tzinfo=UTC) for m in (first, first + months))


@dataclass(frozen=True)
class Translation:
    plan: Plan
    interpretation: str


class Question:
    def __init__(self, text: str, tables: Sequence[Table], now: datetime, default: str | None = None):
        self.words = words_of(text)
        if not self.words:
            raise bad_request("the request is empty")
        self.tables, self.now = tables, now
        self.table = self._table(default)
        self.free = [True] * len(self.words)
        self.plan, self.notes = Plan(self.table.name), []

    def _table(self, default: str | None) -> Table:
        named = [t for t in self.tables if any(called(w, t.name) for w in self.words)]
        for choice in (named, [t for t in self.tables if t.name == default], self.tables if len(self.tables) == 1 else ()):
            if choice:
                return choice[0]
        raise bad_request(f"which table? this database has: {', '.join(t.name for t in self.tables)}")

    # ------------------------------------------------------------------ reading words

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def unclaimed(self) -> Iterator[tuple[int, str]]:
        for i, word in enumerate(self.words):
            if self.free[i]:
                yield i, word

    def claim(self, first: int, last: int) -> None:
        for i in range(first, min(last + 1, len(self.words))):
            self.free[i] = False

    def named_before(self, end: int) -> tuple[str, int] | None:
        """A column in the one to three words before end, past any verb; and where its words begin."""
        while end > 0 and self.words[end - 1] in BEFORE_VERBS:
            end -= 1
        for start in range(end - 1, max(-1, end - 4), -1):
            if column := resolve(self.table, " ".join(self.words[start:end])):
                return column.name, start
        return None

    def named_after(self, start: int) -> tuple[str, int, int] | None:
        """A column that begins within three words of start, the longest name first; and its first and last word."""
        for first in range(start, min(start + 3, len(self.words))):
            for end in (min(first + n, len(self.words)) for n in (3, 2, 1)):
                if column := resolve(self.table, " ".join(self.words[first:end])):
                    return column.name, first, end - 1
        return None

    def time_near(self, i: int) -> str:
        if (found := self.named_before(i)) and self.table.require(found[0]).type in (types.TIMESTAMP, types.DATE):
            return found[0]
        if column := main_time(self.table):
            return column.name
        raise bad_request(f"{self.table.name} has no timestamp column, so a time window cannot be applied")

    # ------------------------------------------------------------------ writing the plan

    def where(self, column: str, op: str, value: object = None) -> None:
        self.plan.filters.append(FilterSpec(column, op, types.render(value) if isinstance(value, datetime) else value))

    def group(self, column: str) -> None:
        self.plan.group_by.append(column)
        self.notes.append(f"grouped by {column}")

    def measure(self, function: str, column: str | None, note: str | None = None) -> None:
        self.plan.metrics.append(nodes.Metric(function, column))
        self.notes.append(note or f"{function}({column})")

    def order(self, column: str, ascending: bool) -> None:
        self.plan.order_by.append(nodes.SortKey(column, ascending))

    # ------------------------------------------------------------------ the rules, in their order

    def one_table(self) -> None:
        several = [t.name for t in self.tables if any(called(w, t.name) for w in self.words)]
        if len(several) > 1:
            raise unsupported(f"that request spans {len(several)} tables ({' and '.join(several)}), which needs a join; one table is queried at a time")
        if any(w.startswith(MISSING_ELSEWHERE) for w in self.words):
            raise unsupported("questions about rows that are missing from another table need a join or an anti-join, which is not executed")

    def relative_time(self) -> None:
        for i, word in self.unclaimed():
            if word not in RELATIVE:
                continue
            count, unit = self.at(i + 1), self.at(i + 2)
            if _WHOLE.fullmatch(count) and (span := SPANS.get(unit.rstrip("s"))):
                column = self.time_near(i)
                self.where(column, "gte", self.now - int(count) * span)
                self.notes.append(f"{column} in the last {int(count)} {unit}")
                self.claim(i, i + 2)
            elif window := calendar(count, int(word != "this"), self.now):
                column = self.time_near(i)
                self.where(column, "gte", window[0])
                self.where(column, "lt", window[1])
                self.notes.append(f"{column} within {word} {count}")
                self.claim(i, i + 1)

    def absolute_time(self) -> None:
        for i, word in self.unclaimed():
            moment = self.at(i + 1)
            if word not in ABSOLUTE or not moment:
                continue
            try:
                types.parse_timestamp(moment)
            except EngineError:
                continue
            column = self.time_near(i)
            self.where(column, ABSOLUTE[word], moment)
            self.notes.append(f"{column} {ABSOLUTE[word]} {moment}")
            self.claim(i, i + 1)

    def year(self) -> None:
        for i, word in self.unclaimed():
            if _WHOLE.fullmatch(word) and 1970 <= int(word) <= 2200 and self.at(i - 1) in ("in", "during", "for"):
                column, year = self.time_near(i), int(word)
                self.where(column, "gte", datetime(year, 1, 1, tzinfo=UTC))
                self.where(column, "lt", datetime(year + 1, 1, 1, tzinfo=UTC))
                self.notes.append(f"{column} during {year}")
                self.claim(i, i)

    def null_checks(self) -> None:
        for i, word in self.unclaimed():
            if word != "is":
                continue
            if self.at(i + 1) in ("null", "empty", "missing"):
                op, last = "is_null", i + 1
            elif self.at(i + 1) == "not" and self.at(i + 2) in ("null", "empty"):
                op, last = "is_not_null", i + 2
            else:
                continue
            if found := self.named_before(i):
                self.where(found[0], op)
                self.notes.append(f"{found[0]} {op}")
                self.claim(found[1], last)

    def comparisons(self) -> None:
        for i, _ in self.unclaimed():
            for phrase, op in COMPARISONS.items():
                at = i + len(phrase)
                if tuple(self.words[i:at]) != phrase or (value := number(self.at(at))) is None or not (found := self.named_before(i)):
                    continue
                self.where(found[0], op, value)
                self.notes.append(f"{found[0]} {op} {json.dumps(value)}")
                self.claim(found[1], at)
                break

    def equalities(self) -> None:
        for i, word in self.unclaimed():
            if word not in EQUALS:
                continue
            op, at = ("ne", i + 2) if self.at(i + 1) == "not" else ("eq", i + 1)
            raw = self.at(at)
            if not raw or not self.free[at] or raw in STOPWORDS or not (found := self.named_before(i)):
                continue
            value: object = raw
            if self.table.require(found[0]).type.numeric and (parsed := number(raw)) is not None:
                value = parsed
            self.where(found[0], op, value)
            self.notes.append(f"{found[0]} {op} {json.dumps(value, ensure_ascii=False)}")
            self.claim(found[1], at)

    def sorting(self) -> None:
        for i, word in enumerate(self.words):
            if word not in ("sorted", "ordered", "order") or self.at(i + 1) != "by" or not (found := self.named_after(i + 2)):
                continue
            column, _, last = found
            down = self.at(last + 1) in ("desc", "descending", "highest", "down")
            self.order(column, not down)
            self.notes.append(f"sorted by {column} {'descending' if down else 'ascending'}")
            self.claim(i, last + down)

    def top(self) -> None:
        for i, word in self.unclaimed():
            if word not in SMALLEST | LARGEST | ANY or not re.fullmatch(r"\+?\d+", self.at(i + 1)):
                continue
            self.plan.limit = int(self.at(i + 1))
            self.claim(i, i + 1)
            self.notes.append(f"at most {self.plan.limit} rows")
            by = next((j for j in range(i + 2, len(self.words)) if self.words[j] == "by"), None)
            found = self.named_after(by + 1) if by is not None else None
            if not found:
                continue
            column, _, last = found
            rising = word in SMALLEST
            subject = resolve(self.table, " ".join(w for w in self.words[i + 2 : by] if w not in STOPWORDS))
            if subject:
                self.group(subject.name)
                declared = self.table.require(column)
                function = declared.default_aggregation or ("sum" if declared.type.numeric else "count")
                metric = nodes.Metric(function, None if function == "count" else column)
                self.plan.metrics.append(metric)
                self.order(metric.name, rising)
            else:
                self.order(column, rising)
                self.notes.append(f"sorted by {column} {'ascending' if rising else 'descending'}")
            self.claim(i + 2, last)

    def subject(self) -> None:
        if self.plan.group_by or self.words[0] not in ASKING or self.at(1) in ("is", "are", "was", "were"):
            return
        if found := self.named_after(1):
            column = self.table.require(found[0])
            label = column.semantic_type in ("category", "country", "id", "email") or (column.type is types.UTF8 and column.default_aggregation is None)
            if label:
                self.group(column.name)
                self.claim(found[1], found[2])

    def grouping(self) -> None:
        for i, word in self.unclaimed():
            if self.plan.group_by:
                return
            if word in ("by", "per", "across", "each") and (found := self.named_after(i + 1)):
                self.group(found[0])
                self.claim(i, i)
                self.claim(found[1], found[2])

    def measures(self) -> None:
        for i, word in self.unclaimed():
            if word in ("count", "counts") or (word, self.at(i + 1)) in (("how", "many"), ("number", "of")):
                self.measure("count", None, "counting rows")
                return self.claim(i, i)
        for i, word in self.unclaimed():
            if not (function := FUNCTIONS.get(word)):
                continue
            if found := self.named_after(i + 1):
                self.claim(found[1], found[2])
                column = self.table.require(found[0])
            else:
                column = self._usual(function)
            if not fits(function, column.type) or function in ("sum", "avg") and not column.measure:
                raise bad_request(f"{function}({column.name}) is not meaningful for a {column.type} column; pick another column")
            self.measure(function, column.name)
            return self.claim(i, i)
        # a column that says how it wants to be aggregated
        for i, word in self.unclaimed():
            column = None if word in STOPWORDS else resolve(self.table, word)
            if column and column.default_aggregation:
                self.measure(column.default_aggregation, column.name)
                return self.claim(i, i)
        return None

    def _usual(self, function: str) -> Column:
        """What "total" or "average" is about when no column is named: the only one that declares it, the only
        currency, the only number."""
        numbers = [c for c in self.table.columns if c.type.numeric and c.measure]
        for choice in ([c for c in self.table.columns if c.default_aggregation == function], [c for c in self.table.columns if c.semantic_type == "currency"], numbers):
            if len(choice) == 1:
                return choice[0]
        raise bad_request(f"{function}() of which column? {self.table.name} has several candidates: {', '.join(c.name for c in numbers)}; name one")

    def finish(self) -> Plan:
        plan = self.plan
        if plan.group_by and not plan.metrics:
            self.measure("count", None, "counting rows per group")
        if plan.metrics:
            plan.operation = "aggregate"
            ranking = bool(plan.group_by) and self.words[0] in ASKING
            if not plan.order_by and (ranking or plan.limit is not None):
                self.order(plan.metrics[0].name, False)
            if ranking and plan.limit is None:
                plan.limit = RANKED
                self.notes.append(f"top {RANKED}")
        elif not (plan.filters or plan.order_by or plan.limit is not None or LISTING & set(self.words)):
            raise bad_request(f"could not turn {' '.join(self.words)!r} into a query plan. Try naming a metric (count, total, average), a column to group by, or a condition, or send a structured plan. Columns of {self.table.name}: {', '.join(self.table.visible())}")
        return plan


_RULES = (
    Question.one_table, Question.relative_time, Question.absolute_time, Question.year, Question.null_checks, Question.comparisons,
    Question.equalities, Question.sorting, Question.top, Question.subject, Question.grouping, Question.measures,
)


def translate(text: str, tables: Sequence[Table], now: datetime, default: str | None = None) -> Translation:
    if not tables:
        raise bad_request("this database has no tables yet")
    question = Question(text, tables, now, default)
    for rule in _RULES:
        rule(question)
    plan = question.finish()
    return Translation(plan, f"reading {question.table.name}" + (f" ({'; '.join(question.notes)})" if question.notes else ""))
