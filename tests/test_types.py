from datetime import UTC, date, datetime

import pytest

from lodeplan import types as t
from lodeplan.errors import EngineError


@pytest.mark.parametrize("text", ["2026-01-01T00:00:00Z", "2026-01-01 00:00:00", "2026-01-01T00:00:00.0", "2026-01-01 00:00", "2026-01-01", "2026-01-01T02:00:00+02:00"])
def test_timestamps_without_zone_are_utc(text):
    assert t.parse_timestamp(text) == datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("value", [1_767_225_600, 1_767_225_600_000, 1_767_225_600_000_000])
def test_epoch_unit_follows_magnitude(value):
    assert t.from_epoch(value) == datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("text", ["", "soon", "2026-13-01", "2026-01-01T09", "2026-02-30"])
def test_other_texts_are_no_timestamps(text):
    with pytest.raises(EngineError) as e:
        t.parse_timestamp(text)
    assert e.value.code == "type_mismatch"


@pytest.mark.parametrize("kind, good", [(t.BOOL, True), (t.INT64, 7), (t.FLOAT64, 7), (t.UTF8, "x"), (t.UUID, "6f1c1f5e-8a1c-4b52-9f0a-0a2b3c4d5e6f"), (t.DATE, "2026-01-02")])
def test_ingest_accepts(kind, good):
    t.accept(kind, good)
    assert t.accept(kind, None) is None


@pytest.mark.parametrize("kind, bad", [(t.BOOL, 1), (t.INT64, "12"), (t.INT64, 1.5), (t.INT64, 5.0), (t.INT64, True), (t.INT64, 2**63), (t.FLOAT64, "1"), (t.UTF8, 1), (t.UUID, "nope"), (t.TIMESTAMP, 1.5)])
def test_ingest_is_strict(kind, bad):
    with pytest.raises(EngineError):
        t.accept(kind, bad)


def test_json_is_kept_as_compact_text():
    assert t.accept(t.JSON, {"a": [1, "é"]}) == '{"a":[1,"é"]}'


def test_literals_may_be_integral_floats_but_not_fractions():
    assert t.literal(t.INT64, 5.0) == 5
    with pytest.raises(EngineError):
        t.literal(t.INT64, 1.5)
    assert t.literal(t.DATE, 1) == date(1970, 1, 2)
    assert t.literal(t.UUID, "anything") == "anything"


def test_rendering():
    assert t.render(float("nan")) is None and t.render(float("inf")) is None
    assert t.render(datetime(2026, 1, 2, 3, 4, 5, 6, UTC)) == "2026-01-02T03:04:05.000006Z"
    assert t.render(date(2026, 1, 2)) == "2026-01-02"


def test_null_sorts_first_and_nan_last_among_values():
    assert t.ordering(None) < t.ordering(-1.0) < t.ordering(1e300) < t.ordering(float("nan"))
