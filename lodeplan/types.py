"""The eight scalar types: what they accept from JSON, how literals meet them, how values print.

Python values stand for each type: bool, int, float, str, aware UTC datetime, date; uuid and json are
strings with a rule at the door.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from typing import Any

from pyspark.sql import types as T

from .errors import EngineError, bad_request, mismatch

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
INT_MIN, INT_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Type:
    name: str
    spark: T.DataType
    numeric: bool = False
    ordered: bool = True

    def __str__(self) -> str:
        return self.name


TYPES = {t.name: t for t in (
    Type("bool", T.BooleanType()), Type("int64", T.LongType(), numeric=True), Type("float64", T.DoubleType(), numeric=True),
    Type("utf8", T.StringType()), Type("timestamp", T.TimestampType()), Type("date", T.DateType()),
    Type("uuid", T.StringType()), Type("json", T.StringType(), ordered=False),
)}
BOOL, INT64, FLOAT64, UTF8, TIMESTAMP, DATE, UUID, JSON = TYPES.values()

_CLOCK = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:([Tt ])(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?(Z|z|[+-]\d\d:?\d\d)?)?")


def parse_timestamp(text: str) -> datetime:
    """RFC 3339, or the same without zone (then UTC), without seconds, or without time."""
    m = _CLOCK.fullmatch(text.strip())
    if m and not (m[9] and (m[4] == " " and not m[7] or not m[7])):
        y, mo, d, _, h, mi, s, frac, zone = m.groups()
        if not (m[4] in ("T", "t") and s is None):
            try:
                at = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0")[:6].ljust(6, "0")), UTC)
            except ValueError:
                raise mismatch("timestamp", json.dumps(text)) from None
            if zone and zone not in "Zz":
                away = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
                at -= away if zone[0] == "+" else -away
            return at
    raise mismatch("timestamp", json.dumps(text))


def from_epoch(value: int) -> datetime:
    """An integer time: seconds below 1e11 in magnitude, milliseconds below 1e14, else microseconds."""
    size = abs(value)
    micros = value * (1_000_000 if size < 10**11 else 1_000 if size < 10**14 else 1)
    try:
        return EPOCH + timedelta(microseconds=micros)
    except OverflowError:
        raise mismatch("timestamp", str(value)) from None


def parse_date(text: str) -> date:
    try:
        return date.fromisoformat(text) if len(text) == 10 else parse_timestamp(text).date()
    except ValueError:
        raise mismatch("date", json.dumps(text)) from None


def _days(value: int) -> date:
    try:
        return date(1970, 1, 1) + timedelta(days=value)
    except OverflowError:
        raise mismatch("date", str(value)) from None


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def accept(kind: Type, value: Any) -> Any:
    """A JSON value on its way into a column; None stays None."""
    if value is None:
        return None
    if kind is JSON:
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if kind is BOOL and isinstance(value, bool):
        return value
    if kind is INT64 and _whole(value) and INT_MIN <= value <= INT_MAX:
        return value
    if kind is FLOAT64 and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is TIMESTAMP and (isinstance(value, str) or _whole(value)):
        return parse_timestamp(value) if isinstance(value, str) else from_epoch(value)
    if kind is DATE and (isinstance(value, str) or _whole(value)):
        # stored days are 32 bits wide, and wrap
        return parse_date(value) if isinstance(value, str) else _days((value + 2**31) % 2**32 - 2**31)
    if isinstance(value, str) and kind in (UTF8, UUID):
        if kind is UUID:
            try:
                uuid.UUID(value)
            except ValueError:
                raise mismatch("uuid", json.dumps(value)) from None
        return value
    raise mismatch(kind.name, json.dumps(value, ensure_ascii=False))


def literal(kind: Type, value: Any) -> Any:
    """A literal that faces a column of this type, as a value of the type."""
    if value is None:
        return None
    if kind is INT64:
        if _whole(value):
            return value
        if isinstance(value, float) and value.is_integer():
            return max(INT_MIN, min(INT_MAX, int(value)))
    elif kind is FLOAT64:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
    elif kind is BOOL:
        if isinstance(value, bool):
            return value
    elif kind is TIMESTAMP:
        if isinstance(value, datetime):
            return value
        if isinstance(value, str):
            return parse_timestamp(value)
        if _whole(value):
            return from_epoch(value)
    elif kind is DATE:
        if isinstance(value, date) and not isinstance(value, datetime):
            return value
        if isinstance(value, str):
            return parse_date(value)
        if _whole(value) and -(2**31) <= value < 2**31:
            return _days(value)
    elif isinstance(value, str):
        return value
    raise mismatch(kind.name, show(value))


def type_of(value: Any) -> Type | None:
    """The type that an untyped literal has by itself."""
    for kinds, found in ((bool, BOOL), (int, INT64), (float, FLOAT64), (str, UTF8), (datetime, TIMESTAMP), (date, DATE)):
        if isinstance(value, kinds):
            return found
    return None


def render(value: Any) -> Any:
    """A value on its way out to JSON."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, datetime):
        at = value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
        return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return value.isoformat() if isinstance(value, date) else value


def show(value: Any) -> str:
    """A literal as plans print it."""
    if value is None:
        return "NULL"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e16:
        return str(int(value))
    return json.dumps(render(value), ensure_ascii=False)


def ordering(value: Any) -> tuple:
    """Places values of one type in order, None first and NaN last."""
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (2,) if math.isnan(value) else (1, value)
    return (1, value)


def named(name: Any) -> Type:
    if name not in TYPES:
        raise EngineError("invalid_schema", f"unknown type {name!r}; one of {', '.join(TYPES)}")
    return TYPES[name]


def scalar(value: Any) -> Any:
    """A JSON filter value, which may not be nested."""
    if isinstance(value, (list, dict)):
        raise bad_request(f"filter values must be scalars, got {json.dumps(value)}")
    if _whole(value) and not INT_MIN <= value <= INT_MAX:
        return float(value)
    return value
