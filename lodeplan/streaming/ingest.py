"""A stream's micro-batches as inserts or upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..context import Context
from ..engine import Engine


def into_table(engine: Engine, ctx: Context, table: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch.  A keyed table takes upserts, so a batch that Spark repeats after a failure
    changes nothing; an append-only table may take such a batch twice."""
    keyed = bool(engine.describe_table(ctx, table).primary_key)

    def batch(df: DataFrame, number: int) -> None:
        (engine.upsert if keyed else engine.insert)(ctx, table, df)

    return batch
