"""Checks, refusals and printed plans; nothing here needs Spark."""

import pytest

from lodeplan.context import Limits
from lodeplan.errors import EngineError
from lodeplan.plans import nodes
from lodeplan.plans.expressions import Between, Binary, Name, Not, OneOf, Value
from lodeplan.plans.pipeline import flatten
from lodeplan.plans.prune import atoms, excluded
from lodeplan.plans.request import Plan, json_schema
from lodeplan.schema import Table

ORDERS = Table.from_json({"name": "orders", "primary_key": ["id"], "columns": [
    {"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "country", "type": "utf8", "semantic_type": "country"},
    {"name": "amount", "type": "float64", "semantic_type": "currency", "default_aggregation": "sum"}, {"name": "created_at", "type": "timestamp", "semantic_type": "timestamp"},
    {"name": "email", "type": "utf8", "semantic_type": "email", "sensitive": True}, {"name": "payload", "type": "json"}, {"name": "paid", "type": "bool"},
]})
LIMITS = Limits(max_rows=100)
SCAN = nodes.Scan("orders")
COUNT = nodes.Metric("count")


def run(plan):
    node = Plan.from_json(plan).logical() if isinstance(plan, dict) else plan
    bound = nodes.bind(node, ORDERS, LIMITS)
    return flatten(bound), bound


def refused(plan, code, text=""):
    with pytest.raises(EngineError, match=text) as e:
        run(plan)
    assert e.value.code == code


def agg(function, column, **more):
    return {"operation": "aggregate", "table": "orders", "metrics": [{"function": function, "column": column}], **more}


def where(column, op, **value):
    return {"table": "orders", "filters": [{"column": column, "op": op, **value}]}


@pytest.mark.parametrize("plan, code, text", [
    (where("nope", "eq", value=1), "not_found", "nope"),
    (where("amount", "eq"), "bad_request", 'needs a "value"'),
    (where("amount", "in"), "bad_request", 'needs "values"'),
    (where("amount", "between", values=[1]), "bad_request", "exactly two"),
    (where("amount", "between", values=[5, 1]), "bad_request", "reversed"),
    (where("amount", "between", values=[5, None]), "bad_request", "reversed"),
    (where("amount", "eq", value=[1]), "bad_request", "must be scalars"),
    (where("id", "gt", value=1.5), "type_mismatch", "int64"),
    (where("paid", "eq", value="true"), "type_mismatch", "bool"),
    (where("amount", "like", value="1%"), "type_mismatch", "text on the left"),
    (where("country", "like", value=1), "bad_request", "string pattern"),
    (where("payload", "lt", value="a"), "bad_request", "supports only = and !="),
    (where("created_at", "gt", value="soon"), "type_mismatch", "timestamp"),
    (where("amount", "near", value=1), "bad_request", "unknown filter op"),
    (agg("sum", "id"), "bad_request", "is not meaningful: id is a id column, not a measure"),
    (agg("avg", "country"), "bad_request", "not defined for type"),
    (agg("max", "payload"), "bad_request", "not defined for type"),
    (agg("sum", None), "bad_request", "needs a column"),
    (agg("count", "email"), "not_found", "email"),
    (agg("count", None, group_by=["payload"]), "bad_request", "cannot be grouped"),
    (agg("count", None, group_by=["country", "country"]), "bad_request", "repeated"),
    (agg("max", "amount", metrics=[{"function": "count", "alias": "x"}, {"function": "max", "column": "amount", "alias": "x"}]), "bad_request", "used twice"),
    (agg("count", None, metrics=[{"function": "count", "alias": "Total"}]), "invalid_identifier", "Total"),
    (agg("count", None, metrics=[]), "bad_request", "at least one metric"),
    ({"table": "orders", "metrics": [{"function": "count"}]}, "bad_request", "operation"),
    ({"table": "orders", "columns": ["id", "id"]}, "bad_request", "requested twice"),
    ({"table": "orders", "columns": ["id"], "order_by": [{"column": "amount"}]}, "not_found", "amount"),
    ({"table": "orders", "order_by": [{"column": "payload"}]}, "bad_request", "cannot be sorted"),
    ({"table": "orders", "offset": 5}, "bad_request", "needs a limit"),
    ({"table": "orders", "having": []}, "bad_request", "no field 'having'"),
    ({"table": "orders", "limit": -1}, "bad_request", "not usable"),
    ({"table": "Orders"}, "invalid_identifier", ""),
    (nodes.Join(SCAN, SCAN, Name("id")), "unsupported", "joins"),
    (nodes.Project(SCAN, ((Binary("*", Name("amount"), Value(2)), "double"),)), "unsupported", "computed projection"),
    (nodes.Filter(nodes.Aggregate(SCAN, ("country",), (COUNT,)), Binary(">", Name("count"), Value(1))), "unsupported", "filter after aggregate"),
    (nodes.Aggregate(nodes.Limit(SCAN, 5), (), (COUNT,)), "unsupported", "aggregate after limit"),
    (nodes.Aggregate(nodes.Aggregate(SCAN, ("country",), (COUNT,)), (), (COUNT,)), "unsupported", "two aggregations"),
    (nodes.Aggregate(nodes.Project(SCAN, ((Name("country"), "c"),)), ("c",), (COUNT,)), "unsupported", "renaming columns before"),
    (nodes.Sort(nodes.Sort(SCAN, (nodes.SortKey("id"),)), (nodes.SortKey("id"),)), "unsupported", "two sorts"),
    (nodes.Filter(SCAN, Name("amount")), "type_mismatch", "boolean filter"),
    (nodes.Filter(SCAN, Not(Name("amount"))), "type_mismatch", "bool"),
    (nodes.Filter(SCAN, Binary("=", Name("id"), Name("country"))), "type_mismatch", "comparable"),
    (nodes.Filter(SCAN, OneOf(Name("id"), ())), "bad_request", "at least one value"),
    (nodes.Scan("orders", ()), "bad_request", "zero columns"),
])
def test_refusals(plan, code, text):
    refused(plan, code, text)


def test_between_null_and_something_passes():
    run(where("amount", "between", values=[None, 5]))


def test_count_min_max_of_ids_are_fine():
    for f in ("count", "min", "max"):
        run(agg(f, "id"))


def test_sensitive_columns_by_name_only():
    assert "email" not in run({"table": "orders"})[1].shape
    assert "email" in run({"table": "orders", "columns": ["email"]})[1].shape
    p, b = run({"table": "orders", "columns": ["id"], "filters": [{"column": "email", "op": "eq", "value": "x"}]})
    assert list(b.shape) == ["id"] and p.columns == ["id", "email"]


def test_limit_is_clamped_with_a_warning():
    p, b = run({"table": "orders", "limit": 500})
    assert p.limit == 100 and "exceeds the 100 row budget" in b.warnings[0]


def test_explain_texts():
    plan = {"operation": "aggregate", "table": "orders", "filters": [{"column": "amount", "op": "gte", "value": 10}, {"column": "country", "op": "in", "values": ["uk", "de"]}], "group_by": ["country"], "metrics": [{"function": "sum", "column": "amount"}], "order_by": [{"column": "sum_amount", "direction": "desc"}], "limit": 5}
    p, b = run(plan)
    assert b.plan.explain() == "limit 5 offset 0\n  sort sum_amount desc\n    aggregate group_by=[country] sum(amount) as sum_amount\n      filter ((amount >= 10) and country in (\"uk\", \"de\"))\n        scan orders [id, country, amount, created_at, payload, paid]\n"
    assert p.explain() == "scan orders [country, amount]\n  prune: amount >= [10] and country in [\"uk\", \"de\"]\n  filter: ((amount >= 10) and country in (\"uk\", \"de\"))\n  aggregate: group_by=[country] sum(amount)\n  sort: sum_amount desc\n  limit: 5 offset 0"
    assert Plan.from_json(Plan.from_json(plan).to_json()) == Plan.from_json(plan)


def test_only_sure_conditions_prune():
    def of(*parts):
        node = nodes.Filter(SCAN, parts[0]) if len(parts) == 1 else None
        return [str(a) for a in atoms(nodes.bind(node, ORDERS, LIMITS).plan.predicate)]

    a, b = Binary(">", Name("id"), Value(3)), Binary("<", Name("id"), Value(9))
    assert of(a & b) == ["id > [3]", "id < [9]"]
    assert of(a | b) == [] == of(Not(a)) == of(Binary("!=", Name("id"), Value(1))) == of(Binary("=", Name("id"), Value(None)))
    assert of(Binary(">", Value(3), Name("id"))) == ["id < [3]"]
    assert of(Between(Name("id"), 1, 2)) == ["id >= [1]", "id <= [2]"]


def test_files_are_excluded_by_statistics():
    stats = {"id": {"min": 10, "max": 20, "nulls": 0}, "country": {"nulls": 5}}

    def out(predicate):
        return excluded(atoms(nodes.bind(nodes.Filter(SCAN, predicate), ORDERS, LIMITS).plan.predicate), 5, stats)

    def cmp(op, v):
        return Binary(op, Name("id"), Value(v))

    assert out(cmp("<", 10)) and not out(cmp("<=", 10)) and out(cmp(">", 20)) and not out(cmp(">=", 20))
    assert out(cmp("=", 9)) and not out(cmp("=", 15)) and out(OneOf(Name("id"), (1, 2))) and not out(OneOf(Name("id"), (1, 12)))
    assert out(Binary("=", Name("country"), Value("uk"))), "all null"
    assert not out(Binary("=", Name("amount"), Value(1.0))), "unknown"


def test_the_schema_of_plans_is_closed():
    schema = json_schema()
    assert schema["additionalProperties"] is False and set(schema["properties"]) >= {"operation", "table", "filters", "metrics", "offset"}
