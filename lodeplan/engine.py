"""The engine: everything a caller can do, behind scopes and budgets.

>>> engine = Engine.open(spark, "/data/warehouse")
>>> engine.query(ctx, {"operation": "aggregate", "table": "orders", "group_by": ["country"], "metrics": [{"function": "sum", "column": "amount"}]})
>>> engine.query(ctx, "top 5 countries by amount in the last 30 days")
>>> engine.frame(ctx, plan)   # the same as a lazy DataFrame, for work that stays in Spark
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, types as T

from . import types
from .catalog import Catalog
from .context import Context
from .errors import EngineError, bad_request, unsupported
from .operators import relational
from .plans import english, nodes
from .plans.pipeline import Pipeline, flatten
from .plans.request import Plan
from .schema import Table, identifier
from .sources.external import ExternalTable, Read, schema_of
from .sources.files import Files, Log
from .sources.store import Store


@dataclass
class Stats:
    segments_read: int = 0
    segments_pruned: int = 0
    bytes_scanned: int = 0
    rows_scanned: int | None = None
    rows_returned: int = 0
    elapsed_ms: float = 0.0
    truncated: bool = False


@dataclass
class Outcome:
    rows: list[dict]
    schema: list[dict]
    stats: Stats
    plan: dict
    explain: str
    warnings: list[str] = field(default_factory=list)
    interpretation: str | None = None

    def to_json(self) -> dict:
        out = {"rows": self.rows, "schema": {"columns": self.schema}, "stats": vars(self.stats), "plan": self.plan, "explain": self.explain}
        if self.warnings:
            out["warnings"] = self.warnings
        return out | ({"interpretation": self.interpretation} if self.interpretation is not None else {})


@dataclass
class Prepared:
    plan: Plan
    logical: nodes.Node
    pipeline: Pipeline
    table: Table
    warnings: list[str]
    interpretation: str | None = None


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.files = Files(spark)
        self.catalog = Catalog(Log(self.files, f"{self.root}/catalog"))

    @classmethod
    def open(cls, spark: SparkSession, root: str, **more: Any) -> Engine:
        """Also removes the folders of tables that the catalog doesn't name."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        engine = cls(spark, root, **more)
        engine._remove_orphans()
        return engine

    def _remove_orphans(self) -> None:
        """Folders of tables whose drop was logged and then interrupted.  A table is logged before its folder is
        made, so the log as read after the folders names every table that another process made meanwhile."""
        base = f"{self.root}/tenants"
        found = []
        for tenant in self.files.folders(base):
            for database in self.files.folders(f"{base}/{tenant}/databases"):
                found += [(tenant, database, t) for t in self.files.folders(f"{base}/{tenant}/databases/{database}/tables")]
        self.catalog.refresh()
        for tenant, database, table in found:
            if table not in self.catalog.now.databases.get((tenant, database), {}):
                self.files.delete(f"{base}/{tenant}/databases/{database}/tables/{table}")

    # ------------------------------------------------------------------ names

    def _database(self, ctx: Context) -> str:
        if ctx.database is None:
            raise bad_request("no database selected")
        return ctx.database

    def _folder(self, ctx: Context, table: str = "") -> str:
        base = f"{self.root}/tenants/{identifier('tenant', ctx.tenant)}/databases/{self._database(ctx)}"
        return f"{base}/tables/{table}" if table else base

    def _table(self, ctx: Context, name: str) -> tuple[Table, str | None]:
        return self.catalog.now.table(ctx.tenant, self._database(ctx), name)

    def _source(self, ctx: Context, name: str) -> Store | ExternalTable:
        _, path = self._table(ctx, name)

        def now() -> Table:
            return self._table(ctx, name)[0]

        return ExternalTable(self.spark, path, now) if path else Store(self.spark, self._folder(ctx, name), now)

    def _store(self, ctx: Context, name: str) -> Store:
        source = self._source(ctx, name)
        if isinstance(source, ExternalTable):
            raise unsupported(f"table {name!r} reads files that others own; it can't be written")
        return source

    # ------------------------------------------------------------------ definitions

    def create_database(self, ctx: Context, name: str) -> None:
        ctx.require("database:write")
        self.catalog.change(kind="create_database", tenant=ctx.tenant, database=identifier("database", name))

    def list_databases(self, ctx: Context) -> list[str]:
        ctx.require("database:read")
        return self.catalog.now.names(ctx.tenant)

    def drop_database(self, ctx: Context, name: str, cascade: bool = False) -> int:
        ctx.require("database:write")
        dropped = len(self.catalog.now.tables(ctx.tenant, name))
        self.catalog.change(kind="drop_database", tenant=ctx.tenant, database=name, cascade=cascade)
        self.files.delete(self._folder(ctx.into(name)))
        return dropped

    def create_table(self, ctx: Context, table: Table, path: str | None = None) -> Table:
        """With a path, the table is Parquet there that others own."""
        ctx.require("schema:write")
        change: dict = {"kind": "create_table", "tenant": ctx.tenant, "database": self._database(ctx), "schema": table.check().to_json()}
        self.catalog.refresh()
        self.catalog.now.apply(change)  # refuse before anything goes
        if path is None:
            self.files.delete(self._folder(ctx, table.name))  # of a table of this name that was dropped half-way
        self.catalog.change(**change, **({"path": path} if path else {}))
        return self.describe_table(ctx.into(ctx.database), table.name, checked=True)

    def register(self, ctx: Context, name: str, path: str, meaning: dict[str, dict] | None = None, **more: Any) -> Table:
        """Parquet at path as a read-only table; meaning: semantic fields by column."""
        return self.create_table(ctx, schema_of(name, self.spark.read.parquet(path), meaning, **more), path)

    def list_tables(self, ctx: Context) -> list[Table]:
        ctx.require("schema:read")
        return [t for _, (t, _) in sorted(self.catalog.now.tables(ctx.tenant, self._database(ctx)).items())]

    def describe_table(self, ctx: Context, name: str, checked: bool = False) -> Table:
        if not checked:
            ctx.require("schema:read")
        return self._table(ctx, name)[0]

    def update_schema(self, ctx: Context, table: Table) -> Table:
        ctx.require("schema:write")
        self.catalog.change(kind="update_schema", tenant=ctx.tenant, database=self._database(ctx), schema=table.to_json())
        return self._table(ctx, table.name)[0]

    def drop_table(self, ctx: Context, name: str) -> None:
        ctx.require("schema:write")
        _, path = self._table(ctx, name)
        self.catalog.change(kind="drop_table", tenant=ctx.tenant, database=self._database(ctx), table=name)
        if path is None:
            self.files.delete(self._folder(ctx, name))

    def table_stats(self, ctx: Context, name: str) -> dict:
        ctx.require("schema:read")
        table, source = self._table(ctx, name)[0], self._source(ctx, name)
        if isinstance(source, ExternalTable):
            files = self.files.walk(source.path)
            rows, size, segments = self.spark.read.parquet(source.path).count(), sum(b for _, b in files), len(files)
        else:
            version = source.version()
            rows, size, segments = version.rows, version.bytes, len(version.files)
        return {"table": name, "rows": rows, "bytes": size, "partitions": table.partitions, "segments": segments, "schema_version": table.version}

    def schema_context(self, ctx: Context) -> str:
        tables = self.list_tables(ctx)
        return "\n".join(t.context() for t in tables) if tables else "(this database has no tables yet)\n"

    # ------------------------------------------------------------------ rows

    def _rows(self, ctx: Context, table: Table, rows: list[dict]) -> DataFrame:
        """JSON rows as a frame with their order in __order; every value is checked here and nowhere else."""
        if len(rows) > ctx.limits.max_write_rows:
            raise EngineError("limit_exceeded", f"{len(rows)} rows exceed the {ctx.limits.max_write_rows} rows of one write")
        out = []
        for place, row in enumerate(rows):
            if not isinstance(row, dict):
                raise bad_request(f"row {place} must be an object")
            for name in row:
                if table.column(name) is None:
                    raise bad_request(f"row {place}: table {table.name} has no column {name!r}")
            values = []
            for c in table.columns:
                try:
                    value = types.accept(c.type, row.get(c.name)) if not (c.type is types.JSON and c.name not in row) else None
                except EngineError as error:
                    raise EngineError(error.code, f"row {place}, column {c.name!r}: {error.message}") from None
                if value is None and not c.nullable:
                    raise bad_request(f"row {place}: column {c.name!r} is required")
                values.append(value)
            out.append((*values, place))
        struct = T.StructType([*table.struct().fields, T.StructField("__order", T.LongType())])
        return self.spark.createDataFrame(out, struct)

    def _keys(self, table: Table, keys: list[Any]) -> DataFrame:
        """Keys as objects, positional arrays, or bare values of a single column."""
        pk = [table.require(k) for k in table.primary_key]
        out = []
        for place, key in enumerate(keys):
            if isinstance(key, dict):
                if set(key) != set(table.primary_key):
                    raise bad_request(f"key {place} must have exactly {', '.join(table.primary_key)}")
                values = [key[c.name] for c in pk]
            else:
                values = key if isinstance(key, list) else [key]
            if len(values) != len(pk):
                raise bad_request(f"key {place} must have {len(pk)} values")
            typed = [types.accept(c.type, v) for c, v in zip(pk, values)]
            if None in typed:
                raise bad_request(f"key {place} has a null")
            out.append((*typed, place))
        return self.spark.createDataFrame(out, T.StructType([*(T.StructField(c.name, c.type.spark) for c in pk), T.StructField("__order", T.LongType())]))

    def insert(self, ctx: Context, name: str, rows: list[dict] | DataFrame) -> dict:
        return self._put(ctx, name, rows, "data:insert", upsert=False)

    def upsert(self, ctx: Context, name: str, rows: list[dict] | DataFrame) -> dict:
        return self._put(ctx, name, rows, "data:update", upsert=True)

    def _put(self, ctx: Context, name: str, rows: list[dict] | DataFrame, scope: str, upsert: bool) -> dict:
        ctx.require(scope)
        table, store = self._table(ctx, name)[0], self._store(ctx, name)
        bulk = isinstance(rows, DataFrame)
        if upsert and not table.primary_key:
            store.upsert(rows if bulk else self.spark.createDataFrame([], table.struct()))  # refuses
        df = self._bulk(table, rows) if bulk else self._rows(ctx, table, rows).coalesce(1)
        if upsert:
            # of bulk rows with one key any one stays: a frame has no order
            written, files = store.upsert(df if not bulk else df.dropDuplicates(list(table.primary_key)), None if bulk else "__order")
        else:
            written, files = store.insert(df)
        store.compact()
        return {"rows": written, "segments_flushed": files}

    def _bulk(self, table: Table, df: DataFrame) -> DataFrame:
        """A frame of the table's columns; missing nullable ones are null, others are refused."""
        from pyspark.sql import functions as F

        have = set(df.columns)
        if extra := sorted(have - {c.name for c in table.columns}):
            raise bad_request(f"table {table.name} has no column {extra[0]!r}")
        for c in table.columns:
            if c.name not in have and not c.nullable:
                raise bad_request(f"column {c.name!r} is required")
        columns = []
        for c in table.columns:
            value = F.col(f"`{c.name}`").cast(c.type.spark) if c.name in have else F.lit(None).cast(c.type.spark)
            columns.append((value if c.nullable else F.coalesce(value, F.raise_error(f"column {c.name} is required"))).alias(c.name))
        return df.select(*columns)

    def get(self, ctx: Context, name: str, keys: list[Any]) -> list[dict]:
        ctx.require("database:read")
        table, store = self._table(ctx, name)[0], self._store(ctx, name)
        store._keyed("get")
        return self._collect(store.get(self._keys(table, keys), "__order"))

    def delete(self, ctx: Context, name: str, keys: list[Any]) -> int:
        ctx.require("data:delete")
        table, store = self._table(ctx, name)[0], self._store(ctx, name)
        store._keyed("delete")
        gone = store.delete(self._keys(table, keys))
        store.compact()
        return gone

    def flush(self, ctx: Context, name: str) -> int:
        """Every accepted write is a commit already, so there is nothing left to flush."""
        ctx.require("data:insert")
        self._store(ctx, name)
        return 0

    def compact(self, ctx: Context, name: str, everything: bool = False) -> int:
        ctx.require("data:insert")
        return self._store(ctx, name).compact(everything)

    def checkpoint(self) -> None:
        """For every table: remove files that no commit names."""
        for (tenant, database), tables in self.catalog.now.databases.items():
            for name, (_, path) in tables.items():
                if path is None:
                    self._store(Context(tenant, database), name).sweep()

    # ------------------------------------------------------------------ questions

    def interpret(self, ctx: Context, request: str, default: str | None = None) -> english.Translation:
        ctx.require("database:read")
        return english.translate(request, self.list_tables(ctx), self.clock(), default)

    def prepare(self, ctx: Context, source: str | dict | Plan) -> Prepared:
        ctx.require("database:read")
        interpretation = None
        if isinstance(source, str):
            translation = self.interpret(ctx, source)
            plan, interpretation = translation.plan, translation.interpretation
        else:
            plan = source if isinstance(source, Plan) else Plan.from_json(source)
        identifier("table", plan.table)
        return self._prepared(ctx, plan, plan.logical(), interpretation)

    def _prepared(self, ctx: Context, plan: Plan, logical: nodes.Node, interpretation: str | None) -> Prepared:
        table, _ = self._table(ctx, plan.table)
        bound = nodes.bind(logical, table, ctx.limits)
        return Prepared(plan, bound.plan, flatten(bound), table, bound.warnings, interpretation)

    def explain(self, ctx: Context, source: str | dict | Plan) -> dict:
        p = self.prepare(ctx, source)
        out = {"plan": p.plan.to_json(), "logical": p.logical.explain(), "physical": p.pipeline.explain()}
        return out | ({"interpretation": p.interpretation} if p.interpretation is not None else {})

    def _read(self, ctx: Context, p: Prepared) -> tuple[DataFrame, Read]:
        source = self._source(ctx, p.table.name)
        if p.pipeline.only_counts and isinstance(source, Store):
            return relational.count_frame(self.spark, p.pipeline, source.version().rows), Read(None, 0, 0, 0, 0)
        read = source.read(p.pipeline.columns, p.pipeline.atoms)
        if read.bytes > ctx.limits.max_bytes_scanned:
            raise EngineError("limit_exceeded", f"the query would scan {read.bytes} bytes, more than the {ctx.limits.max_bytes_scanned} allowed; narrow the filter")
        return relational.build(read.frame, p.pipeline), read

    def frame(self, ctx: Context, source: str | dict | Plan) -> DataFrame:
        """The answer as a lazy DataFrame, under the same checks; the row budget is the caller's matter here."""
        return self._read(ctx, self.prepare(ctx, source))[0]

    def logical_frame(self, ctx: Context, logical: nodes.Node) -> DataFrame:
        """A logical plan built by hand, which can say more than a structured one (or, not, arithmetic, renames)."""
        ctx.require("database:read")
        node = logical
        while node.below is not None:
            node = node.below
        return self._read(ctx, self._prepared(ctx, Plan(node.table), logical, None))[0]

    def query(self, ctx: Context, source: str | dict | Plan) -> Outcome:
        started = time.monotonic()
        p = self.prepare(ctx, source)
        df, read = self._read(ctx, p)
        stats = Stats(read.files, read.pruned, read.bytes, read.rows)
        budget = ctx.limits.max_rows
        if p.pipeline.limit is None:
            df = df.limit(budget + 1)
        rows = self._within(ctx, lambda: self._collect(df))
        if len(rows) > budget:
            rows = rows[:budget]
            if p.pipeline.limit is None:
                stats.truncated = True
                p.warnings.append(f"the result was cut at the {budget} row budget; add a limit or a narrower filter")
        stats.rows_returned, stats.elapsed_ms = len(rows), round((time.monotonic() - started) * 1000, 3)
        schema = [{"name": n, "data_type": k.name, "nullable": nullable} for n, (k, nullable) in p.pipeline.output.items()]
        return Outcome(rows, schema, stats, p.plan.to_json(), p.pipeline.explain(), p.warnings, p.interpretation)

    def _within(self, ctx: Context, work: Callable[[], Any]) -> Any:
        """work under the time budget: its jobs are cancelled when that is over."""
        sc, group, late = self.spark.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event()
        if ctx.limits.max_execution_time_ms <= 0:
            raise EngineError("limit_exceeded", "the query took longer than its 0 ms")

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(ctx.limits.max_execution_time_ms / 1000, stop)
        timer.daemon = True
        sc.setJobGroup(group, f"request {ctx.request_id}", interruptOnCancel=True)
        timer.start()
        try:
            return work()
        except EngineError:
            raise
        except Exception as error:
            if late.is_set():
                raise EngineError("limit_exceeded", f"the query took longer than its {ctx.limits.max_execution_time_ms} ms") from None
            text = str(error).split("\n", 1)[0][:300]
            raise EngineError("bad_request" if "DIVIDE_BY_ZERO" in text or "OVERFLOW" in text else "internal_error", text) from None
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    @staticmethod
    def _collect(df: DataFrame) -> list[dict]:
        def plain(row: Row) -> dict:
            return {n: types.render(Store._aware(v)) for n, v in zip(df.columns, row)}

        return [plain(r) for r in df.collect()]
