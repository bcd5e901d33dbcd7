"""Each step of a pipeline as DataFrame operations; Catalyst does the rest.

Filters and columns reach the Parquet scan, aggregates are partial before their shuffle, a sort with a
limit is a TakeOrderedAndProject, and a limit without a sort stops the scan early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import types
from ..functions.aggregates import aggregate
from ..plans.nodes import SortKey
from ..plans.pipeline import Pipeline


def select(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{n}`") for n in names))


def filtered(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    return df if pipeline.filter is None else df.where(pipeline.filter.spark())


def aggregated(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    if not pipeline.metrics:
        return df
    kinds = dict(df.dtypes)
    metrics = [aggregate(m.function, m.column, kinds.get(m.column or "") == "bigint").alias(m.name) for m in pipeline.metrics]
    return df.groupBy(*(F.col(f"`{k}`") for k in pipeline.group_by)).agg(*metrics)


def renamed(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    if pipeline.renames is None:
        return df
    return df.select(*(F.col(f"`{source}`").alias(alias) for alias, source in pipeline.renames.items()))


def _key(key: SortKey):
    column = F.col(f"`{key.column}`")
    if key.ascending:
        return column.asc_nulls_first() if key.nulls_first else column.asc_nulls_last()
    return column.desc_nulls_first() if key.nulls_first else column.desc_nulls_last()


def ordered(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    return df.orderBy(*map(_key, pipeline.sort)) if pipeline.sort else df


def sliced(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    for limit, offset in pipeline.slices:
        df = (df.offset(offset) if offset else df).limit(limit)
    return df


def build(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    """df: the scan.  The result has exactly the promised columns, in order and type."""
    out = aggregated(filtered(df, pipeline), pipeline)
    out = sliced(ordered(renamed(out, pipeline), pipeline), pipeline)
    return out.select(*(F.col(f"`{name}`").cast(kind.spark) if dict(out.dtypes)[name] != kind.spark.simpleString() else F.col(f"`{name}`") for name, (kind, _) in pipeline.output.items()))


def count_frame(spark, pipeline: Pipeline, rows: int) -> DataFrame:
    """count(*) known beforehand: no file is read."""
    (name,) = pipeline.output
    return sliced(spark.range(1).select(F.lit(rows).cast(types.INT64.spark).alias(name)), pipeline)
