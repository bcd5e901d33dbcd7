"""Packing of token ids into rows of one length, best fit decreasing (operator 1).

Every document becomes its ids and an end-of-document id.  What is longer than a row is cut into whole
rows and a rest, losing nothing.  The rests go, longest first, each into the open row with the least
room that still holds it; a segment tree over the possible rooms finds that row in log2(seq_len) steps.

Rows are packed in blocks of about ``block_tokens`` ids, within the partitions that the documents
already have: nothing is shuffled, memory is bounded by a block however many documents there are, and
a task that is run again makes the same rows.  With thousands of documents in a block the rooms left
over are a small share, which ``n_tokens`` of each row tells.

A row of the result is one line of an id matrix: ``input_ids`` (little-endian, ``id_bytes`` each: 2, or 4 where
the vocabulary or ``end`` goes beyond 16 bits),
``cu_seqlens`` (0 and the end of each segment), ``position_ids`` (which begin at 0 in each segment),
and for each segment its document and the place of its first id there, from which ``unpack`` restores
every document.

Edge cases: null and empty texts are one end-of-document id; a null doc_id stays null in doc_ids; equal
documents and equal ids are packed as often as they occur; texts of any length are split; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bpe, common

SEQ_LEN, BLOCK_TOKENS = 2048, 1 << 21
SMALL, LARGE = np.dtype("<u2"), np.dtype("<u4")
#: Texts of more characters go through the transducer, whose stack doesn't grow with a piece.
LONG_TEXT = 500_000


class Rooms:
    """A segment tree over rooms 0..size: for each inner node, whether an open row has a room below it."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size.bit_length())
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.open[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least need, no longer open; None if there is none."""
        tree, node = self.any, need + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.open[room].pop()
        if not self.open[room]:
            while node and not (node < self.leaves and (tree[2 * node] or tree[2 * node + 1])):
                tree[node] = 0
                node >>= 1
        return row, room


def best_fit(lengths: Iterable[int], size: int) -> list[list[int]]:
    """Rows of indices of lengths, each row's sum at most size."""
    lengths, rooms, rows = list(lengths), Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        row, room = found or (len(rows), size)
        if found is None:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def id_type(highest: int) -> np.dtype:
    return SMALL if highest < 1 << 16 else LARGE


def pack_block(docs: list[tuple[object, np.ndarray]], size: int, pad: int, kind: np.dtype = SMALL) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, list, list[int]]]:
    """(ids, cu_seqlens, position_ids, doc_ids, doc_offsets) of each row."""
    segments = [(d, a, min(size, len(ids) - a)) for d, (_, ids) in enumerate(docs) for a in range(0, len(ids), size)]
    count = np.arange(size, dtype=id_type(size - 1))
    for row in best_fit((n for _, _, n in segments), size):
        ids, at, cuts, positions = np.full(size, pad, kind), 0, [0], np.zeros_like(count)
        for k in row:
            d, a, n = segments[k]
            ids[at : at + n] = docs[d][1][a : a + n]
            positions[at : at + n] = count[:n]
            at += n
            cuts.append(at)
        yield ids, cuts, positions, [docs[segments[k][0]][0] for k in row], [segments[k][1] for k in row]


def pack(docs: DataFrame, path: str, pattern: str, end: int, seq_len: int = SEQ_LEN, block_tokens: int = BLOCK_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """path: the rank file; end: the id after each document, also what fills rows up."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = bpe.load(path, pattern)
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=own.machine.ranks, special_tokens={})
        ids_of = id_type(max([end, *own.machine.vocab]))
        part = TaskContext.get().partitionId()
        block: list[tuple[object, np.ndarray]] = []
        total = made = 0

        def flush() -> pa.RecordBatch:
            rows = list(pack_block(block, seq_len, end, ids_of))
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | made] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([r[0].tobytes() for r in rows], pa.binary()),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2].tobytes() for r in rows], pa.binary()),
                pa.array([r[3] for r in rows], pa.list_(key_type)), pa.array([r[4] for r in rows], pa.list_(pa.int64())), pa.array([r[1][-1] for r in rows], pa.int32()), pa.array([ids_of.itemsize] * n, pa.int32()),
            ], ["block", "row", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_offsets", "n_tokens", "id_bytes"])

        for batch in batches:
            key_type = batch.column(0).type
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = value.as_py() or ""
                ids = fast.encode_ordinary(t) if len(t) <= LONG_TEXT else own.encode(t)
                block.append((key_, np.array([*ids, end], ids_of)))
                total += len(ids) + 1
                if total >= block_tokens:
                    yield flush()
                    block, total, made = [], 0, made + 1
        if block:
            yield flush()

    return docs.select(key, text).mapInArrow(run, f"block bigint, row int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, doc_offsets array<bigint>, n_tokens int, id_bytes int")


def segments(packed: DataFrame) -> DataFrame:
    """The segments of packed rows: doc_id, doc_offset and ids as binary, for restoring documents by order of offset."""
    each = packed.select("input_ids", "id_bytes", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets")).alias("k", "s"))
    start, stop = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    width = F.col("id_bytes")
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"), F.substring("input_ids", start * width + 1, (stop - start) * width).alias("ids"))
