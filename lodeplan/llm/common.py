"""What the corpus operators share: tables, scratch storage and word arithmetic over Arrow buffers.

Scratch tables live below ``spark.checkpoint.dir``, the one folder that the driver and all executors
share, so a lost executor costs a re-read and never a wrong result.  ``release`` deletes what a
session has written there; the same happens when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python at once: some megabytes of text, so that batches stay small beside an executor's heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if it has more."""
    rows = int(spark.conf.get(_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one of our own only where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodeplan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/lodeplan/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and every later use reads the same rows."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, tag)
    df.write.parquet(path, compression=codec)
    del df
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of what is written now
    kept = spark.read.schema(schema).parquet(path)
    kept._scratch = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete what keep has written, once nothing that is still to run reads it; other tables stay."""
    paths = {df.__dict__.get("_scratch") for df in kept}
    for item in [x for x in _made if x[1] in paths]:
        _made.remove(item)
        remove(*item)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def release(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables of a session (of all sessions, for None)."""
    for item in [x for x in _made if spark is None or x[0] is spark]:
        _made.remove(item)
        with contextlib.suppress(Exception):
            remove(*item)


atexit.register(release)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores appended until no column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def extended(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    """df's schema with further columns; for wide rows through Python."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in more)])


#: A key with more than one in so many of the rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; the rows of hot keys are dealt out by a salt.

    counts has the keys and n, the rows that left has of each (keys that right lacks may be missing).  A hot key
    gets one salt for each thousandth of all rows that it holds.  So what is broadcast, hot keys and their
    salts, is below HOT_SHARE rows whatever left's size, and right's copies for all salts are below 2 * HOT_SHARE.
    left must be a table or a projection of one, so that a task that is run again deals its rows out alike."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(*on, F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int")).drop("__salts")
    copies = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


# --------------------------------------------------------------------------- words in Arrow buffers


def word_table(separators: bytes) -> np.ndarray:
    """A byte table: 0 for separators, A-Z lowered, any other byte itself.  Byte-wise rules are exact on
    UTF-8 as long as the separators are ASCII: every byte of a longer sequence is 0x80 or above."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words are [^\x20\x09-\x0D]+ .  NUL would collide with the separator's 0, so it takes 0xFF, which UTF-8 never has.
SPACES = word_table(b" \t\n\x0b\f\r")
SPACES[0] = 0xFF
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z.
ALNUM = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_pw = _powers(_P, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each, at least one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: starts and ends in bytes, first[i]:first[i+1] the words of text i, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, hashes: bool = True, cuts: np.ndarray | None = None):
        """cuts: where a word ends and another begins although no separator is there."""
        global _pw
        self.bytes = low = kinds[data]
        n = len(low)
        inside = low != 0
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edges = offsets[:-1] if cuts is None else np.concatenate([offsets[:-1], cuts])
            edges = edges[edges < n]
            begin[edges] = inside[edges]
            edges = offsets[1:] if cuts is None else np.concatenate([offsets[1:], cuts])
            edges = edges[edges > 0] - 1
            end[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            if not len(self.starts):
                self.hashes = np.zeros(0, np.uint64)
                return
            at = np.arange(n - self.starts[0]) - np.repeat(self.starts - self.starts[0], np.diff(self.starts, append=n))
            longest = int(at.max()) + 1
            if longest > len(_pw):
                _pw = _powers(_P, longest)
            self.hashes = mix(np.add.reduceat(low[self.starts[0] :].astype(np.uint64) * _pw[at], self.starts - self.starts[0]) + (self.ends - self.starts).astype(np.uint64))

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of each one's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hashes[:n].copy()
        q = 1
        for j in range(1, k):
            q = q * _Q % 2**64
            h += self.hashes[j : j + n] * np.uint64(q)
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return mix(h[at] + np.uint64(k)), at
