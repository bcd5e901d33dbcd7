"""Every query against DuckDB's answer, and random plans against plain Python."""

import random

import pytest
from conftest import SF, same

from lodeplan import queries
from lodeplan.context import Context
from lodeplan.engine import Engine
from lodeplan.schema import Table

_all, _sql = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(_all))
def test_query(name, spark, duck):
    same(_all[name](spark, SF), duck, _sql[name])


ORDERS = Table.from_json({"name": "orders", "partitions": 4, "columns": [
    {"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "country", "type": "utf8", "semantic_type": "country"},
    {"name": "amount", "type": "float64", "semantic_type": "currency", "default_aggregation": "sum"}, {"name": "qty", "type": "int64"}, {"name": "note", "type": "utf8"},
]})
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [{"id": i, "country": rng.choice(["uae", "usa", "uk", "de", "sg"]), "amount": None if i % 11 == 0 else rng.randrange(100_000) / 100, "qty": rng.randrange(10) + 1, "note": None if i % 11 == 0 else f"order {i}"} for i in range(4000)]
    engine, ctx = Engine.open(spark, f"file://{tmp_path_factory.mktemp('orders')}"), Context()
    engine.create_database(ctx, "shop")
    ctx = ctx.into("shop")
    engine.create_table(ctx, ORDERS)
    for part in (rows[:1500], rows[1500:1501], rows[1501:]):
        engine.insert(ctx, "orders", part)
    return engine, ctx, rows


def test_random_plans_against_plain_python(orders):
    engine, ctx, rows = orders
    rng = random.Random(5)
    for _ in range(12):
        filters, kept = [], rows
        for _ in range(rng.randrange(3)):
            column = rng.choice(["amount", "qty", "country", "note"])
            op = rng.choice([*COMPARE, "is_null", "in"])
            value = {"amount": round(rng.random() * 1000, 2), "qty": rng.randrange(11), "country": rng.choice(["uk", "de"]), "note": "order 2"}[column]
            if op == "is_null":
                filters.append({"column": column, "op": op})
                kept = [r for r in kept if r[column] is None]
            elif op == "in":
                filters.append({"column": column, "op": op, "values": [value, value]})
                kept = [r for r in kept if r[column] == value]
            else:
                filters.append({"column": column, "op": op, "value": value})
                kept = [r for r in kept if r[column] is not None and COMPARE[op](r[column], value)]
        by = rng.choice([[], ["country"], ["country", "qty"]])
        plan = {"operation": "aggregate", "table": "orders", "filters": filters, "group_by": by, "metrics": [{"function": "count"}, {"function": "sum", "column": "qty"}, {"function": "avg", "column": "amount"}, {"function": "min", "column": "amount"}, {"function": "max", "column": "note"}]}
        groups = {}
        for r in kept:
            groups.setdefault(tuple(r[k] for k in by), []).append(r)
        if not by:
            groups.setdefault((), [])
        want = {}
        for key, own in groups.items():
            amounts = [r["amount"] for r in own if r["amount"] is not None]
            notes = [r["note"] for r in own if r["note"] is not None]
            want[key] = (len(own), sum(r["qty"] for r in own) if own else None, sum(amounts) / len(amounts) if amounts else None, min(amounts, default=None), max(notes, default=None))
        got = {tuple(r[k] for k in by): (r["count"], r["sum_qty"], r["avg_amount"], r["min_amount"], r["max_note"]) for r in engine.query(ctx, plan).rows}
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key]), plan
