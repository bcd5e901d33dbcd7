"""Tables over Spark: mutations, pruning, budgets, recovery."""

import subprocess
import sys
import threading
from dataclasses import replace
from datetime import UTC, datetime

import pytest

from lodeplan.context import Context, Limits
from lodeplan.engine import Engine
from lodeplan.errors import EngineError
from lodeplan.schema import Table
from lodeplan.sources.files import Files, Log
from lodeplan.streaming.ingest import into_table

LEADS = {"name": "leads", "primary_key": ["id"], "partitions": 2, "columns": [
    {"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "company", "type": "utf8", "semantic_type": "category"},
    {"name": "country", "type": "utf8", "semantic_type": "country"}, {"name": "score", "type": "float64", "semantic_type": "score", "default_aggregation": "avg"},
    {"name": "value", "type": "float64", "semantic_type": "currency", "default_aggregation": "sum"}, {"name": "created_at", "type": "timestamp", "semantic_type": "timestamp"},
    {"name": "email", "type": "utf8", "semantic_type": "email", "sensitive": True}, {"name": "extra", "type": "json"},
]}
LOG = {"name": "readings", "partitions": 2, "columns": [{"name": "at", "type": "timestamp", "nullable": False}, {"name": "kind", "type": "utf8", "semantic_type": "category"}, {"name": "n", "type": "int64"}]}


def lead(i):
    return {"id": i, "company": f"company {i % 10}", "country": ("uae", "usa", "uk")[i % 3], "score": i % 100 / 100, "value": 10 * i, "created_at": f"2026-01-{i % 28 + 1:02d}", "email": f"lead{i}@example.com", "extra": {"n": i}}


@pytest.fixture
def home(spark, tmp_path):
    engine = Engine.open(spark, f"file://{tmp_path}", clock=lambda: datetime(2026, 9, 9, 12, tzinfo=UTC))
    ctx = Context()
    engine.create_database(ctx, "crm")
    ctx = ctx.into("crm")
    engine.create_table(ctx, Table.from_json(LEADS))
    engine.insert(ctx, "leads", [lead(i) for i in range(40)])
    return engine, ctx


def refused(code, call, *args, text="", **more):
    with pytest.raises(EngineError) as e:
        call(*args, **more)
    assert e.value.code == code and text in e.value.message
    return e.value


def count(engine, ctx, *filters, table="leads"):
    return engine.query(ctx, {"operation": "aggregate", "table": table, "filters": list(filters), "metrics": [{"function": "count"}]}).rows[0]["count"]


def test_mutations(home):
    engine, ctx = home
    assert count(engine, ctx) == 40
    refused("already_exists", engine.insert, ctx, "leads", [lead(41), lead(3)])
    refused("bad_request", engine.insert, ctx, "leads", [lead(41), lead(41)], text="twice")
    assert count(engine, ctx) == 40, "a refused batch leaves nothing"
    assert engine.upsert(ctx, "leads", [lead(3) | {"value": 1}, lead(3) | {"value": 2}, lead(50)])["rows"] == 2
    assert [r["value"] for r in engine.get(ctx, "leads", [3, {"id": 50}, 999, [3]])] == [2.0, 500.0, 2.0]
    assert engine.get(ctx, "leads", [50])[0]["email"] == "lead50@example.com" and engine.get(ctx, "leads", [50])[0]["extra"] == '{"n":50}'
    assert engine.delete(ctx, "leads", [0, 1, 777]) == 2 and engine.delete(ctx, "leads", [0]) == 0
    before = engine.query(ctx, "total value by country in leads").rows
    assert engine.compact(ctx, "leads", everything=True) > 0
    key = lambda r: r["country"]
    assert sorted(engine.query(ctx, "total value by country in leads").rows, key=key) == sorted(before, key=key)
    stats = engine.table_stats(ctx, "leads")
    assert stats["rows"] == 39 == count(engine, ctx) and stats["segments"] == 1
    engine.insert(ctx, "leads", [lead(0)])
    assert count(engine, ctx) == 40


@pytest.mark.parametrize("row, text", [({"id": 1, "nope": 1}, "no column 'nope'"), ({"company": "x"}, "'id' is required"), ({"id": "7"}, "row 0, column 'id'"), ({"id": 100, "value": "x"}, "column 'value'"), ([1], "must be an object")])
def test_rows_are_checked(home, row, text):
    engine, ctx = home
    with pytest.raises(EngineError) as e:
        engine.insert(ctx, "leads", [row])
    assert text in e.value.message


def test_keys_are_checked(home):
    engine, ctx = home
    for key in ({"id": 1, "x": 2}, [1, 2], None, {"id": None}):
        refused("bad_request", engine.get, ctx, "leads", [key])
    refused("type_mismatch", engine.get, ctx, "leads", ["1"])


def test_append_only_tables(home):
    engine, ctx = home
    engine.create_table(ctx, Table.from_json(LOG))
    rows = [{"at": 1_767_225_600 + k, "kind": "a", "n": k} for k in range(10)]
    engine.insert(ctx, "readings", rows)
    engine.insert(ctx, "readings", rows)
    assert count(engine, ctx, table="readings") == 20
    for call, args in ((engine.upsert, rows), (engine.delete, [1]), (engine.get, [1])):
        refused("unsupported", call, ctx, "readings", args)


def test_evolution_reads_old_rows_as_null(home):
    engine, ctx = home
    spec = engine.describe_table(ctx, "leads").to_json()
    spec["columns"].append({"name": "tier", "type": "utf8"})
    assert engine.update_schema(ctx, Table.from_json(spec)).version == 2
    engine.insert(ctx, "leads", [lead(60) | {"tier": "gold"}])
    assert count(engine, ctx, {"column": "tier", "op": "is_null"}) == 40
    out = engine.query(ctx, {"table": "leads", "columns": ["id"], "filters": [{"column": "tier", "op": "eq", "value": "gold"}]})
    assert out.rows == [{"id": 60}] and out.stats.segments_pruned >= 1, "files older than the column hold none"
    refused("unsupported", engine.update_schema, ctx, Table.from_json(LEADS))


def test_pruning_reads_nothing_that_cannot_match(home):
    engine, ctx = home
    for f in ({"column": "value", "op": "gt", "value": 1e6}, {"column": "id", "op": "eq", "value": -5}, {"column": "country", "op": "is_null"}, {"column": "created_at", "op": "lt", "value": "2020-01-01"}):
        out = engine.query(ctx, {"table": "leads", "filters": [f]})
        assert out.rows == [] and out.stats.segments_read == 0 and out.stats.bytes_scanned == 0
    assert engine.query(ctx, {"table": "leads", "filters": [{"column": "value", "op": "lte", "value": 0}]}).rows[0]["id"] == 0


def test_counting_all_rows_reads_no_file(home):
    engine, ctx = home
    out = engine.query(ctx, "how many leads are there")
    assert out.rows == [{"count": 40}] and out.stats.bytes_scanned == 0 and out.stats.segments_read == 0
    assert engine.query(ctx, {"operation": "aggregate", "table": "leads", "metrics": [{"function": "count"}], "limit": 1, "offset": 1}).rows == []


def test_budgets(home):
    engine, ctx = home

    def under(**limits):
        return ctx.limited(replace(Limits(), **limits))

    out = engine.query(under(max_rows=7), {"table": "leads"})
    assert len(out.rows) == 7 and out.stats.truncated and "cut at the 7 row" in out.warnings[0]
    out = engine.query(under(max_rows=7), {"table": "leads", "limit": 5})
    assert len(out.rows) == 5 and not out.stats.truncated and not out.warnings
    out = engine.query(under(max_rows=7), {"table": "leads", "limit": 50})
    assert len(out.rows) == 7 and not out.stats.truncated and "was reduced" in out.warnings[0]
    refused("limit_exceeded", engine.query, under(max_bytes_scanned=1), {"table": "leads"})
    refused("limit_exceeded", engine.query, under(max_execution_time_ms=0), {"table": "leads"})
    refused("limit_exceeded", engine.insert, under(max_write_rows=1), "leads", [lead(70), lead(71)])


def test_scopes(home):
    engine, ctx = home
    reader = replace(ctx, scopes=frozenset({"database:read"}))
    assert engine.query(reader, {"table": "leads", "limit": 1}).rows
    refused("permission_denied", engine.query, reader, "how many leads", text="schema:read")
    for call, *args in ((engine.insert, "leads", [lead(90)]), (engine.upsert, "leads", []), (engine.delete, "leads", [1]), (engine.create_database, "x"), (engine.drop_table, "leads"), (engine.list_tables,), (engine.compact, "leads")):
        refused("permission_denied", call, reader, *args)


def test_tenants_do_not_see_each_other(home):
    engine, ctx = home
    other = Context("other")
    assert engine.list_databases(other) == []
    refused("not_found", engine.query, other.into("crm"), {"table": "leads"})
    engine.create_database(other, "crm")
    assert engine.list_tables(other.into("crm")) == []


def test_databases_and_tables_come_and_go(home):
    engine, ctx = home
    refused("already_exists", engine.create_database, ctx, "crm")
    refused("already_exists", engine.create_table, ctx, Table.from_json(LEADS))
    refused("bad_request", engine.drop_database, ctx, "crm", text="cascade")
    engine.drop_table(ctx, "leads")
    engine.create_table(ctx, Table.from_json(LEADS))
    assert count(engine, ctx) == 0 and engine.query(ctx, {"table": "leads"}).rows == []
    assert engine.drop_database(ctx, "crm", cascade=True) == 1 and engine.list_databases(ctx) == []


def test_reopening_and_crumbs(home, spark):
    engine, ctx = home
    store = engine._store(ctx, "leads")
    store._write(store.live(), 2)  # files that no commit names, as after a crash between data and commit
    again = Engine.open(spark, engine.root)
    assert count(again, ctx) == 40 and again.query(ctx, {"table": "leads"}).stats.rows_returned == 40
    assert store.sweep() > 0 and store.sweep() == 0
    assert again.query(ctx, {"table": "leads"}).stats.rows_returned == 40


def test_opening_removes_tables_that_were_dropped(home, spark):
    engine, ctx = home
    engine.catalog.change(kind="drop_table", tenant=ctx.tenant, database="crm", table="leads")  # and then the crash
    assert engine.files.folders(f"{engine.root}/tenants/local/databases/crm/tables") == ["leads"]
    again = Engine.open(spark, engine.root)
    assert again.files.folders(f"{engine.root}/tenants/local/databases/crm/tables") == [] and again.list_tables(ctx) == []


def test_the_loser_of_a_race_gets_an_error(home, spark):
    engine, ctx = home
    store = engine._store(ctx, "leads")
    old = store.version()
    engine.delete(ctx, "leads", [1])
    refused("storage_error", store._commit, old, list(old.files), [])


def test_a_damaged_commit_is_corruption(home, spark, tmp_path):
    log = Log(Files(spark), f"file://{tmp_path}/x")
    log.append(1, {"a": 1})
    (tmp_path / "x" / "00000002.json").write_text("{")
    assert log.numbers() == [1, 2] and log.entry(1) == {"a": 1}
    refused("corruption", log.entry, 2)


def test_a_stream_of_upserts(home, spark):
    engine, ctx = home
    batch = into_table(engine, ctx, "leads")
    df = spark.createDataFrame([(3, "new"), (99, "x")], "id bigint, company string")
    batch(df, 0)
    batch(df, 0)
    assert count(engine, ctx) == 41 and engine.get(ctx, "leads", [3])[0]["company"] == "new"


def test_partition_count_does_not_change_answers(home):
    engine, ctx = home
    engine.create_table(ctx, Table.from_json(LEADS | {"name": "wide", "partitions": 8}))
    engine.insert(ctx, "wide", [lead(i) for i in range(40)])
    plans = [{"operation": "aggregate", "group_by": ["country"], "metrics": [{"function": "sum", "column": "value"}, {"function": "min", "column": "created_at"}], "order_by": [{"column": "country"}]}, {"columns": ["id", "score"], "order_by": [{"column": "score"}, {"column": "id", "direction": "desc"}], "limit": 9, "offset": 3}]
    for p in plans:
        assert engine.query(ctx, p | {"table": "leads"}).rows == engine.query(ctx, p | {"table": "wide"}).rows


def test_sums_of_integers_saturate(home):
    engine, ctx = home
    engine.create_table(ctx, Table.from_json(LOG))
    engine.insert(ctx, "readings", [{"at": 1, "kind": k, "n": n} for k, n in (("up", 2**63 - 1), ("up", 5), ("down", -(2**63)), ("down", -1), ("none", None))])
    plan = {"operation": "aggregate", "table": "readings", "group_by": ["kind"], "metrics": [{"function": "sum", "column": "n"}, {"function": "avg", "column": "n"}], "order_by": [{"column": "kind"}]}
    assert [r["sum_n"] for r in engine.query(ctx, plan).rows] == [-(2**63), None, 2**63 - 1]


def test_like_takes_backslashes_before_ordinary_characters(home):
    engine, ctx = home
    engine.upsert(ctx, "leads", [lead(5) | {"company": "50% a\\b"}])
    for pattern, n in (("50\\% a%", 1), ("%a\\b", 1), ("company _", 39), ("COMPANY%", 0)):
        assert count(engine, ctx, {"column": "company", "op": "like", "value": pattern}) == n, pattern


def test_plans_have_the_shape_they_should(home, spark):
    from lodeplan.queries import engine_for

    engine, ctx = engine_for(spark, "/root/testdata/sf0.001")

    def text(plan):
        return engine.frame(ctx, plan)._jdf.queryExecution().toString()

    top = text({"table": "orders", "columns": ["o_orderkey"], "filters": [{"column": "o_orderdate", "op": "gte", "value": "1996-01-01"}], "order_by": [{"column": "o_orderkey"}], "limit": 5})
    assert "TakeOrderedAndProject" in top and "GreaterThanOrEqual(o_orderdate" in top and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in top
    grouped = text({"operation": "aggregate", "table": "lineitem", "group_by": ["l_returnflag"], "metrics": [{"function": "sum", "column": "l_quantity"}]})
    assert "partial_sum" in grouped and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in grouped


def test_a_killed_writer_loses_nothing_that_was_acknowledged(home, tmp_path):
    engine, ctx = home
    code = f"""
import os
from pyspark.sql import SparkSession
from lodeplan.context import Context
from lodeplan.engine import Engine
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
e = Engine.open(spark, {engine.root!r}); c = Context(database="crm")
e.upsert(c, "leads", [{{"id": 1000}}])
s = e._store(c, "leads"); s._write(s.live(), 1)
os._exit(9)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120)
    assert done.returncode == 9, done.stderr[-500:]
    again = Engine.open(engine.spark, engine.root)
    assert count(again, ctx) == 41 and again.get(ctx, "leads", [1000])[0]["id"] == 1000


def test_one_of_many_writers_wins(spark, tmp_path):
    files, won = Files(spark), []

    def write(k):
        try:
            files.commit(f"file://{tmp_path}/log/00000001.json", {"by": k})
            won.append(k)
        except EngineError as error:
            assert error.code == "storage_error"

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read(f"file://{tmp_path}/log/00000001.json") == {"by": won[0]}
    assert [n for n, _ in files.list(f"file://{tmp_path}/log")] == ["00000001.json"]


def test_opening_keeps_what_another_process_has_just_made(spark, tmp_path, monkeypatch):
    root, ctx = f"file://{tmp_path}", Context("acme", "shop")
    first = Engine.open(spark, root)
    first.create_database(Context("acme"), "shop")
    schema = Table.from_json({"name": "leads", "columns": [{"name": "id", "type": "int64", "nullable": False}], "primary_key": ["id"]})
    late = Engine(spark, root)  # has read the log by now
    first.create_table(ctx, schema)
    first.insert(ctx, "leads", [{"id": 1}])
    late._remove_orphans()
    with pytest.raises(EngineError, match="already exists"):
        Engine(spark, root).create_table(ctx, schema)
    assert first.query(ctx, {"table": "leads"}).to_json()["rows"] == [{"id": 1}]
