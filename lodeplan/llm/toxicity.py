"""Toxicity by averaged subword embeddings and a linear softmax (operator 10).

A text is the bag of its words' character n-grams (bytes, with the word's edges as a symbol), hashed
into BUCKETS.  The embeddings of its n-grams are averaged and go through a linear softmax; embeddings
and softmax are trained jointly, in numpy, by AdaGrad on minibatches.  A misspelling that was never seen
shares most n-grams with the word that was.  Since the model is linear after averaging, scoring needs
one number for each bucket and is a vectorised sum over the whole text.

The training sample is bounded: at most POSITIVE toxic and NEGATIVE other rows, those with the smallest
hash of their id among the rows that may be learned from; the true class ratio, counted over all of
those, corrects the intercept.  Everything else sees every row.

Edge cases: null and empty texts, and texts without words, score the prior probability; texts of any
length are scored whole; a null id hashes as '' and is not held out; repeated rows get equal scores;
null labels are not learned from; with no labelled rows of one class the score is the share of toxic
labels (0 without labels); an empty table gives no rows.  Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

POSITIVE, NEGATIVE = 2000, 3000
GRAMS, BUCKETS, DIM, EPOCHS, RATE = (3, 4, 5), 1 << 17, 8, 12, 1.0
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n the bucket at every byte and whether an n-gram begins there; where each text begins."""
    low = common.ALNUM[data]
    n = len(offsets) - 1
    out = np.zeros(len(low) + n + max(GRAMS), np.uint8)  # a 0 before each text: the edge of a word
    out[np.arange(len(low)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = low
    zeros = np.cumsum(out == 0, dtype=np.int32)
    wide, size, found = out.astype(np.uint32), len(low) + n, []
    for g in GRAMS:
        h = np.full(size, g, np.uint32)
        for j in range(g):
            h *= np.uint32(0x01000193)
            h ^= wide[j : j + size]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        found.append((h & np.uint32(BUCKETS - 1), zeros[g - 2 : g - 2 + size] == zeros[:size]))
    return found, offsets[:-1] + np.arange(n)


@dataclass
class Model:
    weights: np.ndarray  #: of each bucket, in log odds for a text that has nothing else
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = common.buffers(column)
        out = [np.zeros(0)]
        for i, j in common.chunks(offsets):
            found, begins = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total = n = 0.0
            for bucket, valid in found:
                total = total + np.add.reduceat(np.where(valid, self.weights[bucket], 0.0), begins)
                n = n + np.add.reduceat(valid, begins, dtype=np.int64)
            out.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.intercept))))
        return np.concatenate(out)


def bags(sample: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of each row of the bounded sample, made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for i in range(batch.num_rows):
                found, _ = grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                own, n = np.unique(np.concatenate([b[v] for b, v in found]), return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column(1)[i : i + 1], pa.array([own.astype(np.uint32).tobytes()]), pa.array([(n / n.sum()).astype(np.float32).tobytes()])], ["y", "b", "w"])

    # by way of a table, read one partition after another: neither the JVM nor Python holds all rows twice
    rows = common.keep(sample.select("text", "y").repartition(16, "text").mapInArrow(run, "y int, b binary, w binary"), "bags").toLocalIterator()
    return sorted(((r.y, np.frombuffer(r.b, np.uint32), np.frombuffer(r.w, np.float32)) for r in rows), key=lambda r: (r[0], len(r[1]), bytes(r[1][:64]), bytes(r[2][:64])))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], odds: float, seed: int = 7) -> Model:
    """odds: of toxic labels among all that may be learned from."""
    rng = np.random.default_rng(seed)
    buckets = np.concatenate([b for _, b, _ in rows]).astype(np.int32)
    cuts = np.cumsum([0, *(len(b) for _, b, _ in rows)])
    shares, labels = np.concatenate([w for _, _, w in rows]), np.array([y for y, _, _ in rows])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    soft[:, 1] = rng.normal(0, 1, DIM)
    soft[:, 0] = -soft[:, 1]
    seen, seen_soft, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full_like(soft, 1e-2), np.full_like(bias, 1e-2)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 128):
            own = order[start : start + 128]
            at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in own])
            sizes = cuts[own + 1] - cuts[own]
            begins, which = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(own)), sizes)
            ids, w = buckets[at], shares[at][:, None]
            hidden = np.add.reduceat(table[ids] * w, begins)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p /= len(own)
            down, g_soft, g_bias = p @ soft.T, hidden.T @ p, p.sum(0)
            by = np.argsort(ids, kind="stable")
            heads = np.flatnonzero(np.diff(ids[by], prepend=-1))
            rows_ = ids[by][heads]
            g = np.add.reduceat(down[which[by]] * w[by], heads)
            seen[rows_] += (g * g).mean(1)
            table[rows_] -= RATE * g / np.sqrt(seen[rows_])[:, None]
            for value, grad, past in ((soft, g_soft, seen_soft), (bias, g_bias, seen_bias)):
                past += grad * grad
                value -= 0.1 * grad / np.sqrt(past)
    weights = np.zeros(BUCKETS)
    used = np.unique(buckets)  # the others are as they were made, at random
    weights[used] = table[used] @ (soft[:, 1] - soft[:, 0])
    positive = labels.mean()
    return Model(weights, float(bias[1] - bias[0] + np.log(odds) - np.log(positive / (1 - positive))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    common.small_batches(docs.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    yes, no = counts.get(1, 0), counts.get(0, 0)
    if yes and no:
        order = F.xxhash64(F.col("doc_id").cast("string"))
        sample = usable.where("y = 1").orderBy(order, "doc_id").limit(POSITIVE).union(usable.where("y = 0").orderBy(order, "doc_id").limit(NEGATIVE))
        rows = bags(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
        if len({y for y, _, _ in rows}) == 2:
            return train(rows, yes / no)
    share = yes / (yes + no) if yes else 0.0
    return Model(np.zeros(BUCKETS), float(np.clip(np.log(share) - np.log1p(-share) if 0 < share < 1 else (800.0 if share else -800.0), -700, 700)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
