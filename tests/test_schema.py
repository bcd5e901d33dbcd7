import pytest

from lodeplan.errors import EngineError
from lodeplan.schema import Column, Table, identifier
from lodeplan import types

ID = {"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}


def table(*columns, **more):
    return Table.from_json({"name": "t", "columns": list(columns), **more})


@pytest.mark.parametrize("name", ["a", "_x", "a-b_9", "a" * 64])
def test_identifiers(name):
    assert identifier("table", name) == name


@pytest.mark.parametrize("name", ["", "A", "9a", "-a", "a b", "a" * 65, None])
def test_other_identifiers(name):
    with pytest.raises(EngineError) as e:
        identifier("table", name)
    assert e.value.code == "invalid_identifier"


@pytest.mark.parametrize("columns, more, text", [
    ([], {}, "at least one column"),
    ([ID, ID], {}, "duplicate column"),
    ([ID], {"partitions": 65}, "partitions must be"),
    ([{"name": "x", "type": "utf8", "currency": "USD"}], {}, "without semantic_type=currency"),
    ([{"name": "x", "type": "utf8", "default_aggregation": "sum"}], {}, "cannot default to aggregation"),
    ([{"name": "x", "type": "json", "default_aggregation": "max"}], {}, "cannot default to aggregation"),
    ([{"name": "x", "type": "int64"}], {"primary_key": ["x"]}, "must be non-nullable"),
    ([{"name": "x", "type": "float64", "nullable": False}], {"primary_key": ["x"]}, "may not be of type"),
    ([ID], {"primary_key": ["id", "id"]}, "duplicate primary key"),
    ([ID], {"primary_key": ["y"]}, "is not defined"),
])
def test_invalid_tables(columns, more, text):
    with pytest.raises(EngineError, match=text) as e:
        table(*columns, **more).check()
    assert e.value.code == "invalid_schema"


def test_evolution():
    old = table(ID, {"name": "x", "type": "utf8"}, primary_key=["id"]).check()
    new = old.evolved(table(ID, {"name": "x", "type": "utf8", "description": "d"}, {"name": "y", "type": "date"}, primary_key=["id"]))
    assert new.version == 2 and new.column("y").type is types.DATE
    for wrong, text in (
        (table(ID, primary_key=["id"]), "dropping"), (table(ID, {"name": "x", "type": "date"}, primary_key=["id"]), "changing the type"),
        (table(ID, {"name": "x", "type": "utf8", "nullable": False}, primary_key=["id"]), "nullability"), (table(ID, {"name": "x", "type": "utf8"}), "primary key"),
        (table(ID, {"name": "x", "type": "utf8"}, primary_key=["id"], partitions=9), "partition count"),
        (table(ID, {"name": "x", "type": "utf8"}, {"name": "y", "type": "utf8", "nullable": False}, primary_key=["id"]), "must be nullable"),
    ):
        with pytest.raises(EngineError, match=text):
            old.evolved(wrong)


def test_round_trip_and_context():
    t = table({**ID, "references": {"table": "u", "column": "id"}}, {"name": "price", "type": "float64", "semantic_type": "currency", "currency": "USD", "default_aggregation": "sum", "description": "Paid."}, {"name": "secret", "type": "utf8", "sensitive": True}, primary_key=["id"], description="Sales")
    assert Table.from_json(t.to_json()) == t
    assert t.context() == "table t: Sales\n  primary key: id\n  id int64 [id, references u.id, required]\n  price float64 [currency, USD, aggregate with sum]: Paid.\n"
    assert t.visible() == ["id", "price"] and isinstance(t.columns[0], Column)
