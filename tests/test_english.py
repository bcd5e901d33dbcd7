"""Questions and the plans they become; the clock stands still."""

from datetime import UTC, datetime

import pytest

from lodeplan.errors import EngineError
from lodeplan.plans.english import translate
from lodeplan.schema import Table

NOW = datetime(2026, 9, 9, 12, tzinfo=UTC)
ID = {"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}


def table(name, *columns, **more):
    return Table.from_json({"name": name, "columns": [ID, *columns], **more})


def c(name, kind, meaning=None, agg=None, **more):
    return {"name": name, "type": kind} | ({"semantic_type": meaning} if meaning else {}) | ({"default_aggregation": agg} if agg else {}) | more


ORDERS = table("orders", c("customer_id", "int64", "id"), c("country", "utf8", "country"), c("amount", "float64", "currency", "sum", description="Total order value before refunds."), c("qty", "int64", "quantity"), c("created_at", "timestamp", "timestamp"), c("buyer_email", "utf8", "email", sensitive=True))
CUSTOMERS = table("customers", c("name", "utf8"), c("country", "utf8", "country"), c("lifetime_value", "float64", "currency", "sum"), c("signup_date", "timestamp", "timestamp"))
LEADS = table("leads", c("company", "utf8", "category"), c("score", "float64", "score", "avg", description="Likelihood to convert, 0 to 1."), c("value", "float64", "currency", "sum"))
TICKETS = table("tickets", c("reopens", "int64"), c("wait_minutes", "float64"))
PRICES = table("prices", c("product", "utf8"), c("retailer", "utf8", "category"), c("price", "float64", "currency", "avg"), c("in_stock", "bool"), c("observed_at", "timestamp", "timestamp"))
BOTH = [CUSTOMERS, ORDERS]


def ask(text, tables=BOTH, default=None):
    return translate(text, tables, NOW, default).plan.to_json()


def agg(table, *metrics, **more):
    return {"operation": "aggregate", "table": table, **more, "metrics": [{"function": m[0]} | ({"column": m[1]} if len(m) > 1 else {}) for m in metrics]}


def f(column, op, value=None):
    return {"column": column, "op": op} | ({} if op.startswith("is_") else {"value": value})


def o(column, direction="desc"):
    return {"column": column, "direction": direction}


@pytest.mark.parametrize("text, plan", [
    ("how many orders are there", agg("orders", ("count",))),
    ("count the orders", agg("orders", ("count",))),
    ("count orders by country", agg("orders", ("count",), group_by=["country"])),
    ("orders per country", agg("orders", ("count",), group_by=["country"])),
    ("total amount by country in orders", agg("orders", ("sum", "amount"), group_by=["country"])),
    ("average amount for orders", agg("orders", ("avg", "amount"))),
    ("maximum amount in orders", agg("orders", ("max", "amount"))),
    ("minimum qty in orders", agg("orders", ("min", "qty"))),
    ("total revenue by country in orders", agg("orders", ("sum", "amount"), group_by=["country"])),
    ("top 5 countries by amount in orders", agg("orders", ("sum", "amount"), group_by=["country"], order_by=[o("sum_amount")], limit=5)),
    ("top 10 orders by amount", {"operation": "select", "table": "orders", "order_by": [o("amount")], "limit": 10}),
    ("customers sorted by lifetime_value desc", {"operation": "select", "table": "customers", "order_by": [o("lifetime_value")]}),
    ("orders sorted by amount", {"operation": "select", "table": "orders", "order_by": [o("amount", "asc")]}),
    ("list orders where amount is greater than 100", {"operation": "select", "table": "orders", "filters": [f("amount", "gt", 100)]}),
    ("list orders with qty at least 3", {"operation": "select", "table": "orders", "filters": [f("qty", "gte", 3)]}),
    ("list orders with amount over 1,000", {"operation": "select", "table": "orders", "filters": [f("amount", "gt", 1000)]}),
    ("list orders where country is uae", {"operation": "select", "table": "orders", "filters": [f("country", "eq", "uae")]}),
    ("list orders where country is null", {"operation": "select", "table": "orders", "filters": [f("country", "is_null")]}),
    ("list orders where country is not null", {"operation": "select", "table": "orders", "filters": [f("country", "is_not_null")]}),
    ("list orders where country is not uae", {"operation": "select", "table": "orders", "filters": [f("country", "ne", "uae")]}),
    ("orders created in the last 90 days", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-06-11T12:00:00.000000Z")]}),
    ("orders in the past 2 weeks", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-08-26T12:00:00.000000Z")]}),
    ("how many customers signed up last month", agg("customers", ("count",), filters=[f("signup_date", "gte", "2026-08-01T00:00:00.000000Z"), f("signup_date", "lt", "2026-09-01T00:00:00.000000Z")])),
    ("orders this year", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-01-01T00:00:00.000000Z"), f("created_at", "lt", "2027-01-01T00:00:00.000000Z")]}),
    ("orders in 2026", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-01-01T00:00:00.000000Z"), f("created_at", "lt", "2027-01-01T00:00:00.000000Z")]}),
    ("orders last quarter", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-04-01T00:00:00.000000Z"), f("created_at", "lt", "2026-07-01T00:00:00.000000Z")]}),
    ("orders this week", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-09-07T00:00:00.000000Z"), f("created_at", "lt", "2026-09-14T00:00:00.000000Z")]}),
    ("show me orders since 2026-01-01", {"operation": "select", "table": "orders", "filters": [f("created_at", "gte", "2026-01-01")]}),
    ("orders before 2026-03-01", {"operation": "select", "table": "orders", "filters": [f("created_at", "lt", "2026-03-01")]}),
    ("list orders", {"operation": "select", "table": "orders"}),
    ("top 3 countries by amount in orders in the last 30 days", agg("orders", ("sum", "amount"), filters=[f("created_at", "gte", "2026-08-10T12:00:00.000000Z")], group_by=["country"], order_by=[o("sum_amount")], limit=3)),
])
def test_questions(text, plan):
    assert ask(text) == plan


@pytest.mark.parametrize("text, table_, plan", [
    ("which companies look most likely to convert", LEADS, agg("leads", ("avg", "score"), group_by=["company"], order_by=[o("avg_score")], limit=10)),
    ("which companies have the highest value", LEADS, agg("leads", ("sum", "value"), group_by=["company"], order_by=[o("sum_value")], limit=10)),
    ("lowest price by product", PRICES, agg("prices", ("avg", "price"), group_by=["product"])),
    ("latest price of standing desk", PRICES, agg("prices", ("max", "price"))),
    ("prices where price is under 20", PRICES, agg("prices", ("avg", "price"), filters=[f("price", "lt", 20)])),
])
def test_readings_that_are_part_of_the_behaviour(text, table_, plan):
    assert ask(text, [table_]) == plan


@pytest.mark.parametrize("text, tables, code, words", [
    ("average for tickets", [TICKETS], "bad_request", "reopens, wait_minutes"),
    ("count orders joined with customers", BOTH, "unsupported", "join"),
    ("customers who haven't purchased", BOTH, "unsupported", "anti-join"),
    ("wibble the flimflam orders", BOTH, "bad_request", "Columns of orders"),
    ("how many are there", BOTH, "bad_request", "which table"),
    ("total customer_id in orders", BOTH, "bad_request", "not meaningful"),
    ("tickets in the last 5 days", [TICKETS], "bad_request", "no timestamp column"),
    ("  ?! ", BOTH, "bad_request", "empty"),
    ("anything", [], "bad_request", "no tables"),
])
def test_refusals(text, tables, code, words):
    with pytest.raises(EngineError, match=words) as e:
        ask(text, tables)
    assert e.value.code == code


def test_interpretation():
    assert translate("total amount by country in orders", BOTH, NOW).interpretation == "reading orders (grouped by country; sum(amount))"
    assert translate("list orders", BOTH, NOW).interpretation == "reading orders"


def test_default_table_and_values_in_lower_case():
    assert ask("how many", default="orders")["table"] == "orders"
    assert ask("list orders where country is UAE")["filters"] == [f("country", "eq", "uae")]


def test_same_question_same_plan():
    assert ask("top 5 countries by amount in orders") == ask("Top 5 countries, by amount in orders?")
