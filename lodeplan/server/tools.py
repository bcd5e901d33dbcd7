"""The fourteen tools: names, argument schemas, and one function that calls them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from .. import types
from ..context import Context
from ..engine import Engine
from ..errors import EngineError, bad_request, not_found
from ..plans.request import Plan, json_schema
from ..schema import AGGREGATIONS, SEMANTICS, Table, identifier

Handler = Callable[[Engine, Context, dict], dict]
_handlers: dict[str, Handler] = {}
_specs: dict[str, dict] = {}

_TEXT = {"type": "string"}
_DATABASE = _TEXT | {"description": "Optional if the key has a default database or there is only one."}
_COLUMN = {
    "type": "object", "required": ["name", "type"], "additionalProperties": False,
    "properties": {
        "name": _TEXT | {"description": "lower-case a-z, 0-9, '_' and '-'"}, "type": {"type": "string", "enum": list(types.TYPES)},
        "nullable": {"type": "boolean", "default": True}, "description": _TEXT, "semantic_type": {"type": "string", "enum": list(SEMANTICS)},
        "unit": _TEXT, "currency": _TEXT, "default_aggregation": {"type": "string", "enum": list(AGGREGATIONS)},
        "sensitive": {"type": "boolean", "default": False},
        "references": {"type": "object", "required": ["table", "column"], "additionalProperties": False, "properties": {"table": _TEXT, "column": _TEXT}},
    },
}
_ROWS = {"type": "array", "items": {"type": "object"}}
_KEYS = {"type": "array", "items": {}, "description": "An object for each key; a bare value for a key of one column."}
_DEFINITION = {"table": _TEXT, "columns": {"type": "array", "items": _COLUMN}, "primary_key": {"type": "array", "items": _TEXT}, "description": _TEXT, "partitions": {"type": "integer", "minimum": 1, "maximum": 64}}


def _tool(name: str, description: str, properties: dict, *required: str, in_database: bool = True) -> Callable[[Handler], Handler]:
    def add(handler: Handler) -> Handler:
        own = (properties | {"database": _DATABASE}) if in_database else properties
        _specs[name] = {"name": name, "description": description, "inputSchema": {"type": "object", "additionalProperties": False, "required": list(required), "properties": own}}

        def run(engine: Engine, ctx: Context, args: dict) -> dict:
            for key in required:
                wanted = {"array": list, "string": str}.get(properties[key].get("type", ""), object)
                if not isinstance(args.get(key), wanted):
                    raise bad_request(f"{name} needs {'an array' if wanted is list else 'a string'} {key!r}")
            if not in_database:
                return handler(engine, ctx, args)
            ctx = _scoped(engine, ctx, args)
            try:
                return handler(engine, ctx, args)
            except EngineError as error:
                raise _with_tables(engine, ctx, error) from None

        _handlers[name] = run
        return handler

    return add


def _scoped(engine: Engine, ctx: Context, args: dict) -> Context:
    if args.get("database") is not None:
        return ctx.into(identifier("database", args["database"]))
    if ctx.database is not None:
        return ctx
    try:
        there = engine.list_databases(ctx)
    except EngineError:
        there = []
    if len(there) == 1:
        return ctx.into(there[0])
    raise bad_request(f'no database selected: pass "database". Available: {", ".join(there) or "(none yet)"}')


def _with_tables(engine: Engine, ctx: Context, error: EngineError) -> EngineError:
    """Says which tables there are to someone who asked for another."""
    if error.code != "not_found" or error.kind != "table":
        return error
    try:
        names = [t.name for t in engine.list_tables(ctx)]
    except EngineError:
        return error
    return bad_request(f"{error.message}. " + (f"Tables in this database: {', '.join(names)}" if names else "This database has no tables yet."))


@_tool("database_create", "Create a database.", {"database": _TEXT}, "database", in_database=False)
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    engine.create_database(ctx, args["database"])
    return {"created": args["database"]}


@_tool("database_list", "List databases.", {}, in_database=False)
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    return {"databases": engine.list_databases(ctx)}


@_tool("database_delete", "Delete a database; one with tables needs cascade.", {"database": _TEXT, "cascade": {"type": "boolean", "default": False}}, "database", in_database=False)
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    return {"deleted": args["database"], "tables_deleted": engine.drop_database(ctx, args["database"], args.get("cascade") is True)}


@_tool("table_create", "Create a table: typed columns, what they mean, and a primary key unless rows are only appended.", _DEFINITION, "table", "columns")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    table = engine.create_table(ctx, Table.from_json({**args, "name": args["table"]}))
    return {"created": table.name, "schema": table.to_json()}


@_tool("table_list", "List tables with their sizes.", {})
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    out = []
    for t in engine.list_tables(ctx):
        stats = engine.table_stats(ctx, t.name)
        out.append({"table": t.name, "description": t.description, "columns": len(t.columns), "primary_key": list(t.primary_key), "rows": stats["rows"], "bytes": stats["bytes"]})
    return {"tables": out}


def _describe(engine: Engine, ctx: Context, args: dict) -> dict:
    return {"schema": engine.describe_table(ctx, args["table"]).to_json(), "stats": engine.table_stats(ctx, args["table"])}


_tool("table_describe", "A table's schema and size.", {"table": _TEXT}, "table")(_describe)


@_tool("table_drop", "Drop a table and its rows.", {"table": _TEXT}, "table")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    engine.drop_table(ctx, args["table"])
    return {"dropped": args["table"]}


@_tool("schema_get", "The schema of one table, or of all with a description in words.", {"table": _TEXT})
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    if args.get("table") is not None:
        return _describe(engine, ctx, args)
    return {"schemas": [t.to_json() for t in engine.list_tables(ctx)], "context": engine.schema_context(ctx)}


@_tool("schema_update", "Add nullable columns or change meanings; pass the complete list of columns.", _DEFINITION, "table", "columns")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    old = engine.describe_table(ctx, args["table"])
    new = Table.from_json({**args, "name": args["table"]})
    kept = {k: getattr(old, k) for k in ("primary_key", "partitions", "description") if args.get(k) is None}
    table = engine.update_schema(ctx, replace(new, _by_name={}, **kept))
    return {"table": table.name, "version": table.version, "schema": table.to_json()}


def _written(args: dict, outcome: dict) -> dict:
    return {"table": args["table"], "rows_written": outcome["rows"], "segments_flushed": outcome["segments_flushed"]}


@_tool("data_insert", "Insert rows; a key that exists refuses the batch.", {"table": _TEXT, "rows": _ROWS}, "table", "rows")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    return _written(args, engine.insert(ctx, args["table"], args["rows"]))


@_tool("data_upsert", "Insert rows or replace those with their keys.", {"table": _TEXT, "rows": _ROWS}, "table", "rows")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    return _written(args, engine.upsert(ctx, args["table"], args["rows"]))


@_tool("data_get", "Rows by primary key, in the order asked for.", {"table": _TEXT, "keys": _KEYS}, "table", "keys")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    rows = engine.get(ctx, args["table"], args["keys"])
    return {"rows": rows, "found": len(rows), "requested": len(args["keys"])}


@_tool("data_delete", "Delete rows by primary key.", {"table": _TEXT, "keys": _KEYS}, "table", "keys")
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    return {"deleted": engine.delete(ctx, args["table"], args["keys"]), "requested": len(args["keys"])}


@_tool("data_query", "Ask in plain English (request) or with a structured plan.", {"request": _TEXT, "plan": json_schema(), "limit": {"type": "integer", "minimum": 0}})
def _(engine: Engine, ctx: Context, args: dict) -> dict:
    request, plan, limit = args.get("request"), args.get("plan"), args.get("limit")
    if (request is None) == (plan is None):
        raise bad_request('data_query: pass either "request" or "plan", not both' if plan is not None else 'data_query: pass "request" (plain language) or "plan" (structured)')
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 0):
        raise bad_request("data_query: limit must be a whole number")
    if request is not None:
        narrowed = ctx if limit is None else ctx.limited(replace(ctx.limits, max_rows=limit))
        return engine.query(narrowed, str(request)).to_json()
    parsed = Plan.from_json(plan)
    return engine.query(ctx, parsed if limit is None else replace(parsed, limit=limit)).to_json()


NAMES = tuple(_specs)


def definitions() -> list[dict]:
    return list(_specs.values())


def call(engine: Engine, ctx: Context, name: str, args: Any = None) -> dict:
    """One tool call; database.create is another way to write database_create."""
    tool = name.replace(".", "_")
    if tool not in _handlers:
        raise not_found("tool", name)
    if args is None:
        args = {}
    if not isinstance(args, dict):
        raise bad_request(f"{tool} arguments must be an object")
    return _handlers[tool](engine, ctx, args)
