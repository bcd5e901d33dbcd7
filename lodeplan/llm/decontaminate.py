"""Benchmark decontamination by a prefix-filtered set join (operator 2).

An item's windows are its runs of ``window`` words (the whole item, if shorter).  A document contains a
window only if it contains all shingles of the window, so it is enough to look for one of them: the
necessary prefix of a full containment is the single rarest shingle, in the order of document
frequencies counted over the whole corpus.  A match proposes one place; length and position must fit
the document there, and then every word is compared.

Work is two scans of the documents without any shuffle of text.  The items are broadcast in blocks of
at most ITEM_BYTES, measured first; each further block costs another pair of scans, so no size of
benchmark is refused and memory stays bounded.

Edge cases: a null text, like an empty one, has no words and is never contaminated; null or wordless
items have no windows; a null item_id counts as the id ''; rows with the same item_id are one item in
counts; repeated documents are separate rows; an empty table on either side gives zero counts (or no
rows).  Texts of any length are one row.  Columns of the input named like the result's are overwritten
in ``contaminated`` only by names the caller passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW, SHINGLE = 10, 5
#: The most bytes of item text that one broadcast holds.  The index of it is about nine times as large, its making takes up to 35 times as much.
ITEM_BYTES = 16 << 20


class Index:
    """The windows of one block of items, found by the shingle that the corpus has least often.  All of it is flat
    arrays: of the items' words, and of the windows sorted by that shingle."""

    def __init__(self, items: pa.Table, window: int, shingle: int):
        """items: columns i and t, both strings."""
        data, offsets = common.buffers(items.column("t").combine_chunks())
        words = common.Words(data, offsets, common.ALNUM)
        self.bytes, self.starts, self.ends, self.hashes = words.bytes, words.starts, words.ends, words.hashes
        ids = items.column("i").fill_null("").combine_chunks().dictionary_encode()
        self.ids = ids.dictionary.to_pylist()
        item, n = ids.indices.to_numpy(zero_copy_only=False), np.diff(words.first)
        size = np.minimum(n, window)
        windows = np.where(n > 0, n - size + 1, 0)
        row = np.repeat(np.arange(len(n)), windows)
        begin = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        first, of = self._distinct(begin, size[row])
        #: Of each different window: its first word, how many words, and between which places of items its items are.
        self.begin, self.size = begin[first], size[row[first]].astype(np.int32)
        pairs = np.unique(of * max(1, len(self.ids)) + item[row])
        self.cuts = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(self.ids)))
        self.items = (pairs % max(1, len(self.ids))).astype(np.int32)
        self.sizes = sorted({min(shingle, int(x)) for x in np.unique(self.size)})
        self.shingle = shingle
        #: By the words of a shingle: their hashes at each word, and 0 to how many places they have in a window.
        self.parts = {k: self._runs(words, k) for k in self.sizes}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _distinct(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each set of equal windows (by 128 bits), and the set of every window."""
        h1, h2 = size.astype(np.uint64), ~size.astype(np.uint64)
        for q in range(int(size.max(initial=0))):
            own = np.flatnonzero(size > q)
            word = self.hashes[begin[own] + q]
            h1[own] = common.mix(h1[own] * np.uint64(0x9E3779B97F4A7C15) + word)
            h2[own] = common.mix((h2[own] ^ word) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return order[new], of

    @staticmethod
    def _runs(words: common.Words, k: int) -> np.ndarray:
        out = np.zeros(len(words.hashes), np.uint64)
        hashes, at = words.shingles(k)
        out[at] = hashes
        return out

    def _of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose shingles have k words, and how many shingles each has."""
        own = np.flatnonzero(np.minimum(self.size, self.shingle) == k)
        return own, self.size[own] - k + 1

    def all_shingles(self) -> dict[int, np.ndarray]:
        out = {}
        for k in self.sizes:
            own, n = self._of(k)
            out[k] = np.unique(np.concatenate([self.parts[k][self.begin[own[n > at]] + at] for at in range(int(n.max()))]))
        return out

    def order(self, shingles: dict[int, np.ndarray], frequency: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix; a window with a shingle that no document has cannot occur.
        frequency: documents that have each of the shingles, in their order."""
        for k in self.sizes:
            own, n = self._of(k)
            least = np.full(len(own), np.iinfo(np.int64).max)
            chosen, offset = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int32)
            for at in range(int(n.max())):
                has = np.flatnonzero(n > at)
                h = self.parts[k][self.begin[own[has]] + at]
                f = frequency[k][np.searchsorted(shingles[k], h)]
                better = (f < least[has]) | (f == least[has]) & (h < chosen[has])
                has, h, f = has[better], h[better], f[better]
                least[has], chosen[has], offset[has] = f, h, at
            some = np.flatnonzero(least > 0)
            some = some[np.argsort(chosen[some], kind="stable")]
            self.prefix[k] = chosen[some], own[some], offset[some]
        self.parts = {}

    def equal(self, w: int, words: common.Words, a: int) -> bool:
        """Whether window w is the text's words from the a-th on."""
        n, b = int(self.size[w]), int(self.begin[w])
        if not np.array_equal(words.hashes[a : a + n], self.hashes[b : b + n]):
            return False
        return all(words.bytes[words.starts[a + q] : words.ends[a + q]].tobytes() == self.bytes[self.starts[b + q] : self.ends[b + q]].tobytes() for q in range(n))


class Sieve:
    """Finds members of a sorted set of hashes among many: a bitmap first, the set for what passes."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.members >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are members, and the first place of each among the members."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.members):
            return at[:0], at[:0]
        where = np.searchsorted(self.members, hashes[at]).clip(max=len(self.members) - 1)
        hit = self.members[where] == hashes[at]
        return at[hit], where[hit]


def _frequencies(docs: DataFrame, text: str, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Documents that have each of the shingles, in their order.  What comes to the driver has at most as many
    rows as one block has shingles, two numbers each."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = shared.value
        sieves = {k: Sieve(v) for k, v in members.items()}
        seen = {k: np.zeros(len(v), np.int64) for k, v in members.items()}
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for i, j in common.chunks(offsets):
                words = common.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], common.ALNUM)
                rows = words.rows()
                for k, sieve in sieves.items():
                    hashes, at = words.shingles(k)
                    hit, where = sieve(hashes)
                    once = np.unique(where * (j - i) + rows[at[hit]])
                    np.add.at(seen[k], once // (j - i), 1)
        for k, counts in seen.items():
            some = np.flatnonzero(counts)
            for a in range(0, len(some), 1 << 16):
                own = some[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own), pa.array(counts[own])], ["k", "place", "n"])

    counted = docs.select(text).mapInArrow(run, "k int, place bigint, n bigint").groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    kinds, places, counts = (counted.column(c).to_numpy() for c in ("k", "place", "n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
    for k in out:
        out[k][places[kinds == k]] = counts[kinds == k]
    return out


def _scan(docs: DataFrame, text: str, index: Index, names: tuple[str, str, str], first: bool, carry: list[str]) -> DataFrame:
    """Adds the number of words, the hit word ranges (start, end, start, end, ...) and the items with a hit."""
    n_name, r_name, i_name = names
    source = docs.select(*dict.fromkeys([*carry, text, *([] if first else names)]))
    at = source.columns.index(text)
    schema = common.extended(source.drop(*names), (n_name, "bigint"), (r_name, "array<int>"), (i_name, "array<string>"))
    columns = source.columns
    keep = [k for k, c in enumerate(columns) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(index)
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sieves = {k: Sieve(p[0]) for k, p in index.prefix.items()}
        for batch in batches:
            old = [batch.column(columns.index(c)).to_pylist() for c in (r_name, i_name)] if not first else None
            counts, ranges, items = [], [], []
            data, offsets = common.buffers(batch.column(at))
            for i, j in common.chunks(offsets):
                words = common.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], common.ALNUM)
                rows = words.rows()
                counts.append(np.diff(words.first))
                own: dict[int, set[tuple[int, int]]] = {}
                got: dict[int, set[int]] = {}
                for k, sieve in sieves.items():
                    chosen, windows, shifts = index.prefix[k]
                    hashes, places = words.shingles(k)
                    hit, where = sieve(hashes)
                    for x, lo, hi in zip(places[hit].tolist(), where.tolist(), np.searchsorted(chosen, hashes[hit], "right").tolist()):
                        row = int(rows[x])
                        begin = x - shifts[lo:hi].astype(np.int64)
                        # length and position first, for all windows of the shingle at once
                        fits = np.flatnonzero((begin >= words.first[row]) & (begin + index.size[windows[lo:hi]] <= words.first[row + 1]))
                        for w, a in zip(windows[lo:hi][fits].tolist(), begin[fits].tolist()):
                            if index.equal(w, words, a):
                                start = a - int(words.first[row])
                                own.setdefault(row, set()).add((start, start + int(index.size[w])))
                                got.setdefault(row, set()).update(index.items[index.cuts[w] : index.cuts[w + 1]].tolist())
                for row in range(j - i):
                    before = old[0][i + row] if old else []
                    spans = sorted([*own.get(row, ()), *zip(before[::2], before[1::2])])
                    merged: list[int] = []
                    for a, b in spans:
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += (a, b)
                    ranges.append(merged)
                    names_ = {index.ids[k] for k in got.get(row, ())}
                    items.append(sorted(names_ | set(old[1][i + row])) if old else sorted(names_))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], out_names)

    return source.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The carried columns of docs (all, for None), then n_words, hit_ranges, hit_items (underscores are
    appended to these three where docs has such columns)."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    common.small_batches(spark)
    names = tuple(common.free_name(docs, n) for n in ("n_words", "hit_ranges", "hit_items"))
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n_blocks = max(1, -(-total // item_bytes) * (2 if total > item_bytes else 1))
    out = docs
    for k in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(n_blocks)) == k) if n_blocks > 1 else rows
        index = Index(block.toArrow(), window, shingle)
        shingles = index.all_shingles()
        index.order(shingles, _frequencies(docs, text, shingles) if shingles else {})
        last = k == n_blocks - 1
        out = _scan(out, text, index, names, k == 0, carry)
        if not last:
            out = common.keep(out, "decontaminate")
    return out.select(*carry, *names)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    n_hit = F.aggregate(F.transform("hit_ranges", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.sort_array("hit_items"), ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    found = find(docs, benchmark)
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)
