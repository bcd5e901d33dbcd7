"""Parquet that somebody else wrote, as a read-only table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from .. import types
from ..plans import prune
from ..schema import Column, Table
from .files import Files

_KINDS = {T.BooleanType: types.BOOL, T.ByteType: types.INT64, T.ShortType: types.INT64, T.IntegerType: types.INT64, T.LongType: types.INT64, T.FloatType: types.FLOAT64, T.DoubleType: types.FLOAT64, T.StringType: types.UTF8, T.TimestampType: types.TIMESTAMP, T.TimestampNTZType: types.TIMESTAMP, T.DateType: types.DATE}


@dataclass
class Read:
    """What one query reads: the frame, and its cost before anything runs."""

    frame: DataFrame
    files: int
    pruned: int
    bytes: int
    rows: int | None = None  #: rows in the files that are read, where that is known


def schema_of(name: str, df: DataFrame, meaning: dict[str, dict] | None = None, **more) -> Table:
    """df's columns of the eight types, each with what meaning says of it; other columns are left out."""
    meaning, columns = meaning or {}, []
    for f in df.schema.fields:
        kind = _KINDS.get(type(f.dataType))
        if kind and f.name == f.name.lower():
            extra = dict(meaning.get(f.name, {}))
            columns.append(Column(f.name, extra.pop("type", kind), f.nullable, **extra))
    return Table(name, tuple(columns), **more).check()


class ExternalTable:
    def __init__(self, spark: SparkSession, path: str, table: Callable[[], Table]):
        self.spark, self.path, self._table = spark, path, table

    def read(self, columns: list[str], atoms: list[prune.Atom]) -> Read:
        """The declared types go into the scan, which widens narrow integers and takes times without zone as UTC,
        so that filters on them are still pushed down."""
        wanted = self._table().struct()
        frame = self.spark.read.schema(T.StructType([wanted[c] for c in columns])).parquet(self.path)
        found = Files(self.spark).walk(self.path)
        return Read(frame, len(found), 0, sum(size for _, size in found))
