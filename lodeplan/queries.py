"""One query for each thing the engine computes, over the driver's tables, with the SQL that says the same.

Every query takes the whole way: a structured plan, a question or a logical plan is checked, bound and
compiled.  Doubles are rounded on both sides, since sums depend on order in their last digits.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .context import Context
from .engine import Engine
from .plans import nodes
from .plans.expressions import Between, Binary, Expr, IsNull, Name, Not, OneOf, Value
from .schema import Table

NOW = datetime(1998, 9, 2, 12, tzinfo=UTC)
_ID, _CATEGORY, _MONEY = {"semantic_type": "id"}, {"semantic_type": "category"}, {"semantic_type": "currency", "default_aggregation": "sum"}
_TIME, _QUANTITY = {"semantic_type": "timestamp"}, {"semantic_type": "quantity"}
#: What the driver's columns mean.
MEANING: dict[str, dict[str, dict]] = {
    "region": {"r_regionkey": _ID, "r_name": _CATEGORY},
    "nation": {"n_nationkey": _ID, "n_regionkey": _ID, "n_name": {"semantic_type": "country"}},
    "customer": {"c_custkey": _ID, "c_nationkey": _ID, "c_acctbal": {"semantic_type": "currency", "default_aggregation": "avg"}, "c_mktsegment": _CATEGORY},
    "supplier": {"s_suppkey": _ID, "s_nationkey": _ID, "s_acctbal": _MONEY},
    "part": {"p_partkey": _ID, "p_brand": _CATEGORY, "p_type": {"semantic_type": "text"}, "p_size": _QUANTITY, "p_retailprice": _MONEY},
    "orders": {"o_orderkey": _ID, "o_custkey": _ID, "o_orderstatus": _CATEGORY, "o_totalprice": _MONEY, "o_orderdate": _TIME, "o_orderpriority": {"semantic_type": "text"}},
    "lineitem": {"l_orderkey": _ID, "l_partkey": _ID, "l_suppkey": _ID, "l_quantity": _QUANTITY, "l_extendedprice": _MONEY, "l_returnflag": _CATEGORY, "l_shipdate": _TIME},
    "events": {"event_id": _ID, "user_id": _ID, "ts": _TIME, "event_type": _CATEGORY, "value": {"semantic_type": "score", "default_aggregation": "avg"}},
}
_engines: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir, which driver and executors share; a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/lodeplan-{uuid.uuid4().hex}"


def engine_for(spark: SparkSession, sf_dir: str) -> tuple[Engine, Context]:
    """An engine whose database has the driver's tables, made once for each session and folder."""
    known = _engines.setdefault(spark, {})
    if sf_dir not in known:
        engine = Engine.open(spark, work_dir(spark), clock=lambda: NOW)
        ctx = Context()
        engine.create_database(ctx, "driver")
        ctx = ctx.into("driver")
        for name, meaning in MEANING.items():
            engine.register(ctx, name, f"{sf_dir}/{name}.parquet", meaning)
        known[sf_dir] = engine, ctx
    return known[sf_dir]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{n}`"), 2).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def ask(name: str, source: dict | str | nodes.Node, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, ctx = engine_for(spark, sf_dir)
        return rounded(engine.logical_frame(ctx, source) if isinstance(source, nodes.Node) else engine.frame(ctx, source))

    _QUERIES[name], _SQL[name] = run, sql


def select(table: str, columns: list[str] | None = None, *filters: tuple, **more) -> dict:
    specs = []
    for column, op, *value in filters:
        specs.append({"column": column, "op": op} | ({"values": value[0]} if op in ("in", "not_in", "between") else {"value": value[0]} if value else {}))
    return {"table": table, "filters": specs} | ({"columns": columns} if columns else {}) | more


def metrics(*pairs: tuple) -> list[dict]:
    return [{"function": f} | ({"column": c[0]} if c and c[0] else {}) | ({"alias": c[1]} if len(c) > 1 else {}) for f, *c in pairs]


def total(table: str, measures: list[dict], by: list[str] = (), *filters: tuple, **more) -> dict:
    return select(table, None, *filters) | {"operation": "aggregate", "group_by": list(by), "metrics": measures} | more


def order(*keys: str) -> list[dict]:
    return [{"column": k.lstrip("-"), "direction": "desc" if k[0] == "-" else "asc"} for k in keys]


# --------------------------------------------------------------------------- projection (S1-S3, J1-J7)
ask("select_star_nation", select("nation"), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
ask("select_columns", select("customer", ["c_name", "c_custkey"]), "SELECT c_name, c_custkey FROM customer")
ask("filter_unreturned_column", select("orders", ["o_orderkey"], ("o_totalprice", "gt", 100000)), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")

_orders = nodes.Scan("orders", ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


def _renaming(below: nodes.Node, **names: str) -> nodes.Project:
    return nodes.Project(below, tuple((Name(source), alias) for alias, source in names.items()))


ask("project_rename", _renaming(_orders, order_id="o_orderkey", price="o_totalprice"), "SELECT o_orderkey AS order_id, round(o_totalprice, 2) AS price FROM orders")
ask("project_stacked", _renaming(_renaming(_orders, a="o_orderkey", b="o_custkey"), key="a"), "SELECT o_orderkey AS key FROM orders")
ask("filter_above_rename", nodes.Filter(_renaming(_orders, order_id="o_orderkey", price="o_totalprice"), Binary(">", Name("price"), Value(200000))), "SELECT o_orderkey AS order_id, round(o_totalprice, 2) AS price FROM orders WHERE o_totalprice > 200000")
ask("sort_renamed", nodes.Limit(nodes.Sort(_renaming(_orders, order_id="o_orderkey", price="o_totalprice"), (nodes.SortKey("price", False), nodes.SortKey("order_id"))), 25), "SELECT o_orderkey AS order_id, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")

# --------------------------------------------------------------------------- filters (P1-P12)
for _op, _symbol in {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.items():
    ask(f"filter_{_op}", select("lineitem", ["l_orderkey", "l_linenumber"], ("l_quantity", _op, 25)), f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity {_symbol} 25")
ask("filter_in", select("orders", ["o_orderkey"], ("o_orderstatus", "in", ["F", "P"])), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
ask("filter_not_in", select("part", ["p_partkey"], ("p_size", "not_in", [1, 2, 3])), "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)")
ask("not_in_null", total("part", metrics(("count",)), [], ("p_size", "not_in", [1, None])), "SELECT count(*) AS count FROM part WHERE p_size NOT IN (1, NULL)")
ask("eq_null", total("part", metrics(("count",)), [], ("p_size", "eq", None)), "SELECT count(*) AS count FROM part WHERE p_size = NULL")
ask("filter_between", select("orders", ["o_orderkey"], ("o_totalprice", "between", [50000, 60000])), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
ask("filter_like_prefix", select("part", ["p_partkey", "p_type"], ("p_type", "like", "PROMO%")), "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
ask("filter_like_underscore", select("part", ["p_partkey"], ("p_brand", "like", "Brand#_1")), "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_1'")
ask("filter_is_null", total("customer", metrics(("count",)), [], ("c_acctbal", "is_null")), "SELECT count(*) AS count FROM customer WHERE c_acctbal IS NULL")
ask("filter_is_not_null", total("customer", metrics(("count",)), [], ("c_acctbal", "is_not_null")), "SELECT count(*) AS count FROM customer WHERE c_acctbal IS NOT NULL")
ask("filter_and_multi", select("lineitem", ["l_orderkey", "l_linenumber"], ("l_returnflag", "eq", "R"), ("l_quantity", "lt", 10), ("l_discount", "gte", 0.05)), "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 AND l_discount >= 0.05")
for _name, _value in {"string": "1996-01-01", "string_time": "1996-01-01T00:00:00Z", "epoch_s": 820454400, "epoch_ms": 820454400000, "epoch_us": 820454400000000}.items():
    ask(f"filter_ts_{_name}", total("orders", metrics(("count",)), [], ("o_orderdate", "gte", _value)), "SELECT count(*) AS count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")

# --------------------------------------------------------------------------- logical predicates (X1-X7)
_lines = nodes.Scan("lineitem", ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"))


def _keys_where(name: str, predicate: Expr, sql: str) -> None:
    ask(name, _renaming(nodes.Filter(_lines, predicate), l_orderkey="l_orderkey", l_linenumber="l_linenumber"), f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE {sql}")


def _is(column: str, op: str, value: object) -> Binary:
    return Binary(op, Name(column), Value(value))


_keys_where("ir_or", _is("l_quantity", "<", 3) | _is("l_quantity", ">", 48), "l_quantity < 3 OR l_quantity > 48")
_keys_where("kleene_not", Not(_is("l_quantity", "<", 40) & _is("l_discount", ">", 0.03)), "NOT (l_quantity < 40 AND l_discount > 0.03)")
_keys_where("ir_not_between", Between(Name("l_quantity"), 5, 45, negated=True), "l_quantity NOT BETWEEN 5 AND 45")
_keys_where("ir_not_in", OneOf(Name("l_linenumber"), (1, 2, 3), negated=True), "l_linenumber NOT IN (1, 2, 3)")
_keys_where("ir_arith", Binary(">", Binary("*", Name("l_quantity"), Name("l_discount")), Value(4.0)), "l_quantity * l_discount > 4")
_keys_where("ir_int_division", Binary("=", Binary("/", Name("l_orderkey"), Value(7)), Name("l_linenumber")), "l_orderkey // 7 = l_linenumber")
_keys_where("ir_col_col", Binary("<", Name("l_suppkey"), Name("l_linenumber")), "l_suppkey < l_linenumber")
_keys_where("ir_mixed_col_col", Binary("<=", Name("l_quantity"), Name("l_linenumber")), "l_quantity <= l_linenumber")
_keys_where("ir_literal_left", Binary(">", Value(3), Name("l_quantity")), "3 > l_quantity")
_keys_where("ir_is_null", IsNull(Name("l_tax")) | IsNull(Name("l_discount"), negated=True) & _is("l_tax", "=", 0.08), "l_tax IS NULL OR (l_discount IS NOT NULL AND l_tax = 0.08)")

# --------------------------------------------------------------------------- aggregates (A1-A12)
ask("count_star", total("lineitem", metrics(("count",))), "SELECT count(*) AS count FROM lineitem")
ask("count_col", total("orders", metrics(("count", "o_orderkey"))), "SELECT count(o_orderkey) AS count_o_orderkey FROM orders")
ask("sum_float", total("lineitem", metrics(("sum", "l_extendedprice"))), "SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem")
ask("sum_int", total("part", metrics(("sum", "p_size", "sizes"))), "SELECT sum(p_size)::BIGINT AS sizes FROM part")
ask("avg_float", total("customer", metrics(("avg", "c_acctbal"))), "SELECT round(avg(c_acctbal), 2) AS avg_c_acctbal FROM customer")
ask("avg_int", total("part", metrics(("avg", "p_size"))), "SELECT round(avg(p_size), 2) AS avg_p_size FROM part")
ask("min_max_num", total("lineitem", metrics(("min", "l_tax"), ("max", "l_quantity"))), "SELECT round(min(l_tax), 2) AS min_l_tax, round(max(l_quantity), 2) AS max_l_quantity FROM lineitem")
ask("min_max_str", total("customer", metrics(("min", "c_name"), ("max", "c_mktsegment"))), "SELECT min(c_name) AS min_c_name, max(c_mktsegment) AS max_c_mktsegment FROM customer")
ask("min_max_ts", total("orders", metrics(("min", "o_orderdate", "first"), ("max", "o_orderdate", "last"))), "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
ask("min_max_id", total("orders", metrics(("min", "o_orderkey"), ("max", "o_custkey"))), "SELECT min(o_orderkey) AS min_o_orderkey, max(o_custkey) AS max_o_custkey FROM orders")
ask("agg_empty_ungrouped", total("part", metrics(("count",), ("sum", "p_size"), ("avg", "p_retailprice"), ("max", "p_name")), [], ("p_partkey", "lt", 0)), "SELECT count(*) AS count, sum(p_size)::BIGINT AS sum_p_size, avg(p_retailprice) AS avg_p_retailprice, max(p_name) AS max_p_name FROM part WHERE p_partkey < 0")
ask("agg_empty_grouped", total("part", metrics(("count",)), ["p_brand"], ("p_partkey", "lt", 0)), "SELECT p_brand, count(*) AS count FROM part WHERE p_partkey < 0 GROUP BY p_brand")
ask("group_one", total("lineitem", metrics(("sum", "l_extendedprice", "revenue")), ["l_returnflag"]), "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
ask("group_two", total("lineitem", metrics(("count",), ("sum", "l_quantity", "sum_qty"), ("avg", "l_discount", "avg_disc")), ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 2) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus")
ask("group_by_timestamp", total("orders", metrics(("count",)), ["o_orderdate"]), "SELECT o_orderdate, count(*) AS count FROM orders GROUP BY o_orderdate")
ask("group_many", total("orders", metrics(("sum", "o_totalprice", "spent"), ("count",)), ["o_custkey"]), "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, count(*) AS count FROM orders GROUP BY o_custkey")
ask("group_filtered", total("orders", metrics(("count",), ("max", "o_totalprice")), ["o_orderpriority"], ("o_orderstatus", "eq", "F")), "SELECT o_orderpriority, count(*) AS count, round(max(o_totalprice), 2) AS max_o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")

# --------------------------------------------------------------------------- order and limit (O1-O6)
ask("sort_multi", select("nation", None, order_by=order("n_regionkey", "-n_name")), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation ORDER BY n_regionkey, n_name DESC")
ask("topn_rows", select("orders", ["o_orderkey", "o_totalprice"], order_by=order("-o_totalprice", "o_orderkey"), limit=20), "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
ask("topn_group", total("orders", metrics(("sum", "o_totalprice", "spent")), ["o_custkey"], order_by=order("-spent", "o_custkey"), limit=20), "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
ask("page_offset", select("customer", ["c_custkey", "c_name"], order_by=order("c_custkey"), limit=10, offset=30), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")
ask("limit_zero", select("customer", ["c_custkey"], limit=0), "SELECT c_custkey FROM customer LIMIT 0")
ask("limit_stacked", nodes.Limit(nodes.Limit(nodes.Sort(nodes.Scan("customer", ("c_custkey",)), (nodes.SortKey("c_custkey"),)), 10), 20, 5), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 5")
ask("pruned_range_count", total("events", metrics(("count",)), [], ("event_id", "gte", 100), ("event_id", "lt", 200)), "SELECT count(*) AS count FROM events WHERE event_id >= 100 AND event_id < 200")

# --------------------------------------------------------------------------- English (N0-N13); the clock stands at NOW
ask("nl_count", "how many orders are there", "SELECT count(*) AS count FROM orders")
ask("nl_group_sum", "total revenue by o_orderstatus in orders", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY o_orderstatus")
ask("nl_per", "orders per o_orderpriority", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority")
ask("nl_top_n", "top 3 o_orderpriority by o_totalprice in orders", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY o_orderpriority ORDER BY sum(o_totalprice) DESC LIMIT 3")
ask("nl_comparison", "count orders where o_totalprice is greater than 100,000", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000")
ask("nl_equality", "count events where event_type is click", "SELECT count(*) AS count FROM events WHERE event_type = 'click'")
ask("nl_last_n_days", "how many orders in the last 900 days", "SELECT count(*) AS count FROM orders WHERE o_orderdate >= TIMESTAMP '1998-09-02 12:00:00' - INTERVAL 900 DAY")
ask("nl_last_year", "total o_totalprice in orders last year", "SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
ask("nl_year", "count orders in 1996 by o_orderstatus", "SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_orderstatus")
ask("nl_since", "how many orders since 1997-06-01", "SELECT count(*) AS count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
ask("nl_average", "average c_acctbal by c_mktsegment for customer", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS avg_c_acctbal FROM customer GROUP BY c_mktsegment")
ask("nl_which_ranking", "which c_mktsegment has the highest balance in customer by c_acctbal", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS avg_c_acctbal FROM customer GROUP BY c_mktsegment ORDER BY avg(c_acctbal) DESC LIMIT 10")
ask("nl_null_check", "how many orders where o_custkey is not null", "SELECT count(*) AS count FROM orders WHERE o_custkey IS NOT NULL")
ask("nl_sorted", "list nation sorted by n_name desc", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation ORDER BY n_name DESC")


# --------------------------------------------------------------------------- tables of our own (M1-M9, D1-D6)
def _own(spark: SparkSession, sf_dir: str) -> tuple[Engine, Context]:
    """nation and events as own tables: nation keyed; events appended, with NULLs where event_id divides by 11."""
    engine = Engine.open(spark, work_dir(spark), clock=lambda: NOW)
    ctx = Context()
    engine.create_database(ctx, "own")
    ctx = ctx.into("own")
    engine.create_table(ctx, Table.from_json({"name": "nation", "primary_key": ["n_nationkey"], "partitions": 2, "columns": [{"name": "n_nationkey", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "n_name", "type": "utf8", "semantic_type": "country"}, {"name": "n_regionkey", "type": "int64"}]}))
    engine.insert(ctx, "nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return engine, ctx


def mutate(name: str, change: Callable[[Engine, Context], DataFrame | None], sql: str, plan: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, ctx = _own(spark, sf_dir)
        found = change(engine, ctx)
        return engine.frame(ctx, plan or {"table": "nation"}) if found is None else found

    _QUERIES[name], _SQL[name] = run, sql


_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _upsert(engine: Engine, ctx: Context) -> None:
    engine.upsert(ctx, "nation", [{"n_nationkey": 3, "n_name": "OLD", "n_regionkey": 9}, {"n_nationkey": 3, "n_name": "NEW", "n_regionkey": 9}, {"n_nationkey": 100, "n_name": None}])


def _delete(engine: Engine, ctx: Context) -> None:
    engine.delete(ctx, "nation", [1, {"n_nationkey": 2}, [3], 999])


def _evolve(engine: Engine, ctx: Context) -> None:
    spec = engine.describe_table(ctx, "nation").to_json()
    spec["columns"].append({"name": "note", "type": "utf8"})
    engine.update_schema(ctx, Table.from_json(spec))
    engine.insert(ctx, "nation", [{"n_nationkey": 200, "n_name": "X", "n_regionkey": 1, "note": "new"}])


def _compact(engine: Engine, ctx: Context) -> None:
    _upsert(engine, ctx)
    _delete(engine, ctx)
    engine.compact(ctx, "nation", everything=True)


def _get(engine: Engine, ctx: Context) -> DataFrame:
    rows = engine.get(ctx, "nation", [7, 5, 999, 7])
    return engine.spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], "place bigint, n_nationkey bigint, n_name string, n_regionkey bigint")


mutate("insert_visible", lambda e, c: None, _NATION)
mutate("upsert_visible", _upsert, f"{_NATION} WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'NEW', 9 UNION ALL SELECT 100, NULL, NULL")
mutate("delete_visible", _delete, f"{_NATION} WHERE n_nationkey NOT IN (1, 2, 3)")
mutate("get_by_key", _get, "SELECT k.place::BIGINT AS place, n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation JOIN (VALUES (7, 0), (5, 1), (7, 2)) AS k(key, place) ON n_nationkey = k.key")
mutate("compact_neutral", _compact, f"{_NATION} WHERE n_nationkey NOT IN (1, 2, 3) UNION ALL SELECT 100, NULL, NULL")
mutate("evolve_backfill", _evolve, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, NULL::VARCHAR AS note FROM nation UNION ALL SELECT 200, 'X', 1, 'new'")
mutate("count_from_log", _delete, "SELECT count(*) - 3 AS count FROM nation", {"operation": "aggregate", "table": "nation", "metrics": [{"function": "count"}]})


def nulls(name: str, plan: dict | nodes.Node, sql: str) -> None:
    """Over a table with NULLs, which the driver's have not."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, ctx = _own(spark, sf_dir)
        spec = {"name": "readings", "partitions": 3, "columns": [{"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "kind", "type": "utf8", "semantic_type": "category"}, {"name": "value", "type": "float64", "semantic_type": "score"}]}
        engine.create_table(ctx, Table.from_json(spec))
        gap = F.col("event_id") % 11 == 0
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        engine.insert(ctx, "readings", events.select(F.col("event_id").alias("id"), F.when(~gap, F.col("event_type")).alias("kind"), F.when(~gap, F.col("value")).alias("value")))
        return rounded(engine.logical_frame(ctx, plan) if isinstance(plan, nodes.Node) else engine.frame(ctx, plan))

    _QUERIES[name] = run
    _SQL[name] = f"WITH readings AS (SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events) {sql}"


nulls("group_null_key", total("readings", metrics(("count",), ("count", "value"), ("avg", "value")), ["kind"]), "SELECT kind, count(*) AS count, count(value) AS count_value, round(avg(value), 2) AS avg_value FROM readings GROUP BY kind")
nulls("filter_is_null_own", select("readings", ["id"], ("kind", "is_null")), "SELECT id FROM readings WHERE kind IS NULL")
nulls("ne_drops_null", total("readings", metrics(("count",)), [], ("kind", "ne", "click")), "SELECT count(*) AS count FROM readings WHERE kind <> 'click'")
nulls("not_unknown", nodes.Aggregate(nodes.Filter(nodes.Scan("readings"), Not(_is("value", ">", 10))), (), (nodes.Metric("count"),)), "SELECT count(*) AS count FROM readings WHERE NOT (value > 10)")
nulls("sort_nulls_last_asc", select("readings", ["id", "kind"], order_by=order("kind", "id")), "SELECT id, kind FROM readings ORDER BY kind ASC NULLS LAST, id")
nulls("sort_nulls_last_desc", select("readings", ["id", "kind"], order_by=order("-kind", "id")), "SELECT id, kind FROM readings ORDER BY kind DESC NULLS LAST, id")
nulls("sort_nulls_first", nodes.Limit(nodes.Sort(nodes.Scan("readings", ("id", "kind")), (nodes.SortKey("kind", True, True), nodes.SortKey("id"))), 12), "SELECT id, kind FROM readings ORDER BY kind ASC NULLS FIRST, id LIMIT 12")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
