"""Keyed and append-only tables over versioned Parquet.

A table is a folder: ``data/`` with immutable files, ``deletes/`` with rows that no longer count (file and
row number), and ``log/`` with numbered commits.  Each commit lists the live files with their rows, bytes
and column statistics, and the live delete files.  Reading a version prunes files by statistics and
anti-joins the deletes; writing makes new files and then one commit, so a crash leaves files that no
commit names, which ``sweep`` removes, and never half a batch.  Two writers race for the next number
and the loser gets an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .. import types
from ..errors import EngineError, bad_request, unsupported
from ..plans import prune
from ..schema import Table
from .external import Read
from .files import Files, Log

#: Deletes are broadcast up to this many; beyond it the anti-join shuffles.
BROADCAST_DELETES = 1_000_000
#: Compaction: a file with this share of dead rows; or this many files, of which the smallest merge.
DEAD_SHARE, MANY_FILES, MERGE_FILES, MERGE_BYTES = 0.25, 8, 16, 512 << 20
_FILE, _ROW, _ORDER = "__file", "__row", "__order"


@dataclass(frozen=True)
class DataFile:
    path: str
    rows: int
    bytes: int
    schema_version: int
    stats: dict[str, dict[str, Any]] = field(default_factory=dict)
    dead: int = 0

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]


@dataclass(frozen=True)
class Version:
    number: int = 0
    files: tuple[DataFile, ...] = ()
    deletes: tuple[str, ...] = ()

    @property
    def rows(self) -> int:
        return sum(f.rows - f.dead for f in self.files)

    @property
    def dead(self) -> int:
        return sum(f.dead for f in self.files)

    @property
    def bytes(self) -> int:
        return sum(f.bytes for f in self.files)


def _to_json(value: Any) -> Any:
    return types.render(value)


class Store:
    def __init__(self, spark: SparkSession, path: str, table: Callable[[], Table]):
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        self.files = Files(spark)
        self.log = Log(self.files, f"{self.path}/log")

    # ------------------------------------------------------------------ versions

    def version(self) -> Version:
        numbers = self.log.numbers()
        if not numbers:
            return Version()
        entry, table = self.log.entry(max(numbers)), self.table()
        try:
            found = tuple(DataFile(f["path"], f["rows"], f["bytes"], f["schema_version"], self._typed(f["stats"], table), f["dead"]) for f in entry["files"])
            return Version(max(numbers), found, tuple(entry["deletes"]))
        except (KeyError, TypeError):
            raise EngineError("corruption", f"{self.path} has a commit that can't be read") from None

    @staticmethod
    def _typed(stats: dict, table: Table) -> dict:
        out = {}
        for name, s in stats.items():
            column = table.column(name)
            if column:
                out[name] = {"nulls": s["nulls"]} | {k: types.literal(column.type, s[k]) for k in ("min", "max") if s.get(k) is not None}
        return out

    def _commit(self, old: Version, files: list[DataFile], deletes: list[str]) -> Version:
        entry = {
            "files": [{"path": f.path, "rows": f.rows, "bytes": f.bytes, "schema_version": f.schema_version, "dead": f.dead, "stats": {c: {k: _to_json(v) for k, v in s.items()} for c, s in f.stats.items()}} for f in files],
            "deletes": deletes,
        }
        self.log.append(old.number + 1, entry)
        return Version(old.number + 1, tuple(files), tuple(deletes))

    def sweep(self) -> int:
        """Remove files that the last commit doesn't name; the number removed.  Not while others read or write."""
        now = self.version()
        named = {f.path for f in now.files}
        gone = [p for p, _ in (self.files.walk(f"{self.path}/data") if self.files.exists(f"{self.path}/data") else []) if self._relative(p) not in named]
        for path in gone:
            self.files.delete(path)
        self.log.forget(now.number)
        return len(gone)

    def _relative(self, path: str) -> str:
        return "data" + path.rpartition("/data")[2]

    # ------------------------------------------------------------------ reading

    def _scan(self, version: Version, files: list[DataFile], columns: list[str], places: bool = False) -> DataFrame:
        struct = self.table().struct()
        kept = T.StructType([struct[c] for c in columns])
        if not files:
            empty = T.StructType([*kept.fields, *([T.StructField(_FILE, T.StringType()), T.StructField(_ROW, T.LongType())] if places else [])])
            return self.spark.createDataFrame([], empty)
        df = self.spark.read.schema(kept).parquet(*(f"{self.path}/{f.path}" for f in files))
        names = [F.col(f"`{c}`") for c in columns]
        if not places and not any(f.dead for f in files):
            return df
        df = df.select(*names, F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        if version.deletes and any(f.dead for f in files):
            gone = self.spark.read.schema(f"{_FILE} string, {_ROW} bigint").parquet(*(f"{self.path}/{d}" for d in version.deletes))
            df = df.join(F.broadcast(gone) if version.dead <= BROADCAST_DELETES else gone, [_FILE, _ROW], "left_anti")
        return df if places else df.select(*names)

    def read(self, columns: list[str], atoms: list[prune.Atom]) -> Read:
        version = self.version()
        kept = [f for f in version.files if not prune.excluded(atoms, f.rows, self._with_new_columns(f))]
        return Read(self._scan(version, kept, columns), len(kept), len(version.files) - len(kept), sum(f.bytes for f in kept), sum(f.rows - f.dead for f in kept))

    def _with_new_columns(self, f: DataFile) -> dict:
        """A column that a file is older than is null throughout it."""
        if f.schema_version == self.table().version:
            return f.stats
        return {c.name: {"nulls": f.rows} for c in self.table().columns if c.name not in f.stats} | f.stats

    def live(self) -> DataFrame:
        version = self.version()
        return self._scan(version, list(version.files), [c.name for c in self.table().columns])

    # ------------------------------------------------------------------ writing

    def _write(self, df: DataFrame, partitions: int) -> list[DataFile]:
        table = self.table()
        folder = f"data/{uuid.uuid4().hex}"
        keys = [F.col(f"`{k}`") for k in table.primary_key]
        spread = df.repartition(partitions, *keys) if keys else df.repartition(partitions)
        writer = spread.write.option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in table.columns:
            if c.looked_up and c.name in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
        writer.parquet(f"{self.path}/{folder}")
        return self._described(folder)

    def _described(self, folder: str) -> list[DataFile]:
        """The files of a folder with their statistics: one aggregation over what was written."""
        table = self.table()
        exprs = [F.count(F.lit(1)).alias("rows")]
        for k, c in enumerate(table.columns):
            exprs.append(F.count_if(F.col(f"`{c.name}`").isNull()).alias(f"n{k}"))
            if c.type.ordered:
                exprs += [F.min(f"`{c.name}`").alias(f"a{k}"), F.max(f"`{c.name}`").alias(f"b{k}")]
        sizes = {p.rpartition("/")[2]: size for p, size in self.files.walk(f"{self.path}/{folder}")}
        found = self.spark.read.schema(table.struct()).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("file")).agg(*exprs).collect()
        out = []
        for r in found:
            stats = {}
            for k, c in enumerate(table.columns):
                stats[c.name] = {"nulls": r[f"n{k}"]}
                low, high = (r[f"a{k}"], r[f"b{k}"]) if c.type.ordered else (None, None)
                long = any(isinstance(v, str) and len(v) > 256 or isinstance(v, float) and v != v for v in (low, high))
                if low is not None and not long:
                    stats[c.name] |= {"min": self._aware(low), "max": self._aware(high)}
            out.append(DataFile(f"{folder}/{r.file}", r.rows, sizes[r.file], table.version, stats))
        return sorted(out, key=lambda f: f.path)

    @staticmethod
    def _aware(value: Any) -> Any:
        from datetime import UTC, datetime

        return value.astimezone(UTC) if isinstance(value, datetime) else value

    def _places(self, keys: DataFrame, version: Version) -> DataFrame:
        """file, row and key of the live rows with these keys (distinct)."""
        pk = list(self.table().primary_key)
        return self._scan(version, list(version.files), pk, places=True).join(keys.select(*pk).distinct(), pk, "left_semi")

    def _mark(self, places: DataFrame, version: Version) -> tuple[list[DataFile], list[str], int]:
        """Write a delete file; the files with their new numbers of dead rows."""
        path = f"deletes/{uuid.uuid4().hex}"
        places.select(_FILE, _ROW).write.parquet(f"{self.path}/{path}")
        counts = {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/{path}").groupBy(_FILE).count().collect()}
        if not counts:
            return list(version.files), list(version.deletes), 0
        files = [replace(f, dead=f.dead + counts.get(f.name, 0)) for f in version.files]
        return files, [*version.deletes, path], sum(counts.values())

    def _keyed(self, what: str) -> list[str]:
        table = self.table()
        if not table.primary_key:
            raise unsupported(f"{what} needs a primary key, and {table.name} has none (append-only)")
        return list(table.primary_key)

    def insert(self, df: DataFrame) -> tuple[int, int]:
        """Add rows; a key twice in the batch or already in the table refuses all of it.  Rows and files written."""
        table, version = self.table(), self.version()
        df = df.select(*(F.col(f"`{c.name}`") for c in table.columns))
        if pk := list(table.primary_key):
            twice = df.groupBy(*pk).count().where("count > 1").limit(1).collect()
            if twice:
                raise bad_request(f"key {self._key_text(twice[0], pk)} occurs twice in this batch")
            there = self._places(df, version).limit(1).collect() if version.files else []
            if there:
                raise EngineError("already_exists", f"a row with key {self._key_text(there[0], pk)} already exists")
        new = self._write(df, table.partitions)
        if not new:
            return 0, 0
        self._commit(version, [*version.files, *new], list(version.deletes))
        return sum(f.rows for f in new), len(new)

    @staticmethod
    def _key_text(row: Any, pk: list[str]) -> str:
        return "{" + ", ".join(f"{k}: {types.show(row[k])}" for k in pk) + "}"

    def upsert(self, df: DataFrame, order: str | None = None) -> tuple[int, int]:
        """Put rows in the place of those with their keys.  order: a column of df; of rows with one key the last stays."""
        pk, table, version = self._keyed("upsert"), self.table(), self.version()
        if order:
            last = Window.partitionBy(*pk).orderBy(F.col(order).desc())
            df = df.withColumn("__n", F.row_number().over(last)).where("__n = 1")
        df = df.select(*(F.col(f"`{c.name}`") for c in table.columns))
        new = self._write(df, table.partitions)
        if not new:
            return 0, 0
        written = self.spark.read.schema(table.struct()).parquet(*(f"{self.path}/{f.path}" for f in new))
        files, deletes, _ = self._mark(self._places(written, version), version) if version.files else ([], [], 0)
        self._commit(version, [*files, *new], deletes)
        return sum(f.rows for f in new), len(new)

    def delete(self, keys: DataFrame) -> int:
        """Remove rows by key; keys that aren't there are ignored.  The number removed."""
        self._keyed("delete")
        version = self.version()
        if not version.files:
            return 0
        files, deletes, gone = self._mark(self._places(keys, version), version)
        if gone:
            self._commit(version, files, deletes)
        return gone

    def get(self, keys: DataFrame, order: str) -> DataFrame:
        """Whole rows by key in the order of keys, one for each time a key is asked for."""
        pk = self._keyed("get")
        return self.live().join(keys.select(*pk, F.col(order).alias(_ORDER)), pk).orderBy(_ORDER).select(*(F.col(f"`{c.name}`") for c in self.table().columns))

    def compact(self, everything: bool = False) -> int:
        """Rewrite files with many dead rows, or merge the smallest ones; the number of files rewritten."""
        version = self.version()
        chosen = [f for f in version.files if f.dead >= DEAD_SHARE * f.rows and f.dead]
        if everything:
            chosen = list(version.files)
        elif not chosen and len(version.files) >= MANY_FILES:
            total = 0
            for f in sorted(version.files, key=lambda f: f.bytes)[:MERGE_FILES]:
                total += f.bytes
                if total > MERGE_BYTES:
                    break
                chosen.append(f)
            if len(chosen) < 2:
                chosen = []
        if not chosen:
            return 0
        rows = self._scan(version, chosen, [c.name for c in self.table().columns])
        new = self._write(rows, max(1, -(-sum(f.bytes for f in chosen) // MERGE_BYTES)))
        rest = [f for f in version.files if f not in chosen]
        # deletes that only concern rewritten files go with them
        self._commit(version, [*rest, *new], list(version.deletes) if any(f.dead for f in rest) else [])
        return len(chosen)
