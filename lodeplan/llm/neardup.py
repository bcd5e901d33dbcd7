"""Near-duplicate documents by min-max hashing (operator 9).

A document is its set of shingles of four words (five in ``clean``).  Each of PERMUTATIONS hash functions is evaluated once
and gives two signature values, the minimum and the maximum over the set; BANDS bands of four values
propose pairs.  Two sets of similarity 0.8 share no band once in about 10^7 times; whatever a band
proposes is confirmed on the full sets.

Equal sets are one class from the start.  Within a bucket every class is compared with the bucket's
first class only, so a group of copies costs one comparison for each member and band, not for each
pair.  That leaves open only pairs of one bucket whose classes are still in different components; these
are compared in a second round, so no link between components is lost, and pairs within a component
need no confirmation.  The second round leaves out, exactly, what can't be a link: a set's odd sketch has
ODD bits, one of them flipped by each shingle, so the bits in which two sketches differ are at most the
shingles in which the sets do.  A copy edited too much to be linked is so told from a family of thousands
by a few longs each.

Memory is bounded by one batch of documents; links, components and sets stay in tables.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; texts of fewer
words than a shingle are one shingle; texts of any length are one row; repeated rows are one class; a
null doc_id is no candidate for the smallest id of its component (the component of nothing but such
rows is null and they are kept); an empty table gives no rows; other columns are carried by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, graph

#: Words of a shingle: of the query by its contract, and of the pipeline's stage.
SHINGLE, STAGE_SHINGLE = 4, 5
PERMUTATIONS, BANDS, PERCENT, ODD = 64, 32, 80, 1024
_rng = np.random.default_rng(20_260_901)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = common.Words(data, offsets, common.SPACES)
    hashes, at = words.shingles(k)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(len(offsets) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            own = np.sort(hashes[cuts[i] : cuts[i + 1]])
            out.append(own[np.flatnonzero(np.diff(own, prepend=own[0] ^ np.uint64(1)))])
        elif b > a:
            one = object.__new__(common.Words)
            one.hashes, one.first = words.hashes[a:b], np.array([0, b - a])
            out.append(one.shingles(int(b - a))[0])
        else:
            out.append(hashes[:0])
    return out


def bands(of: list[np.ndarray]) -> np.ndarray:
    """The band keys of each set (rows of zeros for empty sets)."""
    sizes = np.array([len(s) for s in of])
    out = np.zeros((len(of), BANDS), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate([of[i] for i in full])
    begins = np.cumsum([0, *sizes[full][:-1]])
    ends = [np.empty((PERMUTATIONS, len(full)), np.uint64) for _ in range(2)]
    for p in range(PERMUTATIONS):
        h = (values ^ _X[p]) * _A[p]
        np.minimum.reduceat(h, begins, out=ends[0][p])
        np.maximum.reduceat(h, begins, out=ends[1][p])
    per = PERMUTATIONS // BANDS
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for p in range(b * per, (b + 1) * per):
            for e in ends:
                key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + e[p])
        out[full, b] = key
    return out


def _print(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _row(key: str, text: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("r"), text, key).alias("r2")]


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """id, r1, r2 (of the row), n, fp (of the set), bands."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for i, j in common.chunks(offsets):
                own = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                keys = bands(own).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], batch.column(3)[i:j], pa.array([len(s) for s in own], pa.int64()), pa.array([_print(s) for s in own], pa.binary()), lists], ["id", "r1", "r2", "n", "fp", "bands"])

    return docs.select(key, text, *_row(key, text)).mapInArrow(run, f"id {kind}, r1 bigint, r2 bigint, n bigint, fp binary, bands array<bigint>")


def odd_sketch(values: np.ndarray) -> np.ndarray:
    flips = np.bincount((values >> np.uint64(32)).astype(np.int64) % ODD, minlength=ODD)
    return np.packbits(flips % 2 == 1).view(np.int64)


def _full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """nid, set and odd sketch, for the classes of wanted (nid, r1, r2): read again from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for i, j in common.chunks(offsets):
                own = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], pa.array([x.tobytes() for x in own], pa.binary()), pa.array([odd_sketch(x) for x in own], pa.list_(pa.int64()))], ["nid", "set", "odd"])

    # rows that repeat id and text are one, combined before the shuffle
    rows = docs.select(*_row(key, text), F.col(text).alias("t")).join(wanted, ["r1", "r2"]).select("t", "nid")
    return rows.groupBy("nid").agg(F.first("t").alias("t")).select("t", "nid").mapInArrow(run, "nid bigint, set binary, odd array<bigint>")


def _confirm(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * inter >= PERCENT * (len(both) - inter):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left, right = of.select(F.col("nid").alias("a"), F.col("set").alias("x")), of.select(F.col("nid").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sized(a: str, b: str):
    """No pair can be similar enough unless the sizes are."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, r1, r2, n_shingles and best of every row: best (no, id, r1, r2) is the row of the smallest id in its
    component, null where n_shingles is 0."""
    common.small_batches(docs.sparkSession)
    rows = common.keep(signatures(docs, key, text, shingle), "signatures")
    order = F.struct(F.col("id").isNull().alias("no"), "id", "r1", "r2")
    classes = rows.where("n > 0").groupBy("fp").agg(F.min(order).alias("best"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = common.keep(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    # the first of a bucket is the class of most rows, then of the smallest id: in a family that is likely the original
    rank = F.struct((-F.col("copies")).alias("c"), F.col("best.id").alias("o"), "nid", "n")
    placed = classes.select("nid", "n", rank.alias("rank"), F.explode("bands").alias("band"))
    first = placed.groupBy("band").agg(F.min("rank").alias("lo"), F.min("nid").alias("a"), F.max("nid").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b")
    first = common.keep(first.select("band", F.col("lo.nid").alias("hub"), F.col("lo.n").alias("hub_n"), F.col("n").alias("size")), "hubs")
    sizes = first.select("band", F.col("size").alias("n"))
    shared = common.keep(common.join_hot(placed.select("band", "nid", "n"), first.drop("size"), ["band"], sizes).select("band", "nid", "n", "hub", "hub_n"), "buckets")
    stars = common.keep(shared.where((F.col("nid") != F.col("hub")) & _sized("n", "hub_n")).select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct(), "stars")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = shared.select("nid").distinct()
    full = common.keep(_full_sets(docs, key, text, classes.select("nid", "best.r1", "best.r2").join(members, "nid"), shingle), "sets")
    links = common.keep(_confirm(stars, full), "confirmed")
    comps = common.keep(graph.components(links), "components")
    # pairs of a bucket that are not in one component yet
    mine = F.coalesce(F.col("comp"), F.col("nid"))
    labelled = shared.select("band", "nid", "n", "hub").join(comps.withColumnRenamed("node", "nid"), "nid", "left").select("band", "nid", "n", "hub", mine.alias("comp"))
    of_hub = labelled.where("nid = hub").select("band", F.col("comp").alias("hub_comp"))
    mixed = labelled.join(of_hub, "band").withColumn("strange", F.col("comp") != F.col("hub_comp"))
    mixed = mixed.join(full.select("nid", "odd"), "nid")
    mixed = common.keep(mixed.select("band", "nid", "n", "comp", "strange", "odd"), "mixed")
    strangers = mixed.where("strange").select("band", F.col("nid").alias("nid1"), F.col("n").alias("n1"), F.col("comp").alias("comp1"), F.col("odd").alias("odd1"))
    differ = sum((F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("odd1", F.lit(k)))) for k in range(1, ODD // 64)), F.bit_count(F.get("odd", F.lit(0)).bitwiseXOR(F.get("odd1", F.lit(0)))))
    # similar sets of n and n1 shingles differ in at most this share of n + n1
    reachable = _sized("n", "n1") & (differ * (100 + PERCENT) <= (F.col("n") + F.col("n1")) * (100 - PERCENT))
    # of two strangers, either would find the pair: the one with the smaller nid does
    once = ~F.col("strange") | (F.col("nid1") < F.col("nid"))
    open_pairs = strangers.join(mixed, "band").where((F.col("comp") != F.col("comp1")) & once & reachable).select(F.least("nid", "nid1").alias("a"), F.greatest("nid", "nid1").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = common.keep(_confirm(open_pairs, full), "confirmed")
    if not more.isEmpty():
        comps = common.keep(graph.components(links.union(more)), "components")
    linked = comps.withColumnRenamed("node", "nid").join(classes.select("nid", "fp", "best"), "nid")
    smallest = linked.groupBy("comp").agg(F.min("best").alias("least"))
    linked = linked.join(smallest, "comp").select("fp", "least")
    labels = classes.select("fp", "best").join(linked, "fp", "left").select("fp", F.coalesce("least", "best").alias("best"))
    labels, copies = common.keep(labels, "labels"), classes.select("fp", F.col("copies").alias("n"))
    return common.join_hot(rows.select("id", "r1", "r2", "n", "fp"), labels, ["fp"], copies, "left").select("id", "r1", "r2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best")).alias("best"))


def digests(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    out = groups(docs, shingle=shingle)
    comp = F.when(F.col("n_shingles") > 0, F.col("best.id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """docs with one row of each group: that of the smallest id."""
    r1, r2, n = (common.free_name(docs, x) for x in ("r1", "r2", "n"))
    out = groups(docs, key, text, shingle).where("n_shingles > 0").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.first("best").alias("best"))
    marked = docs.select("*", *(c.alias(x) for c, x in zip(_row(key, text), (r1, r2))))
    lose = (F.col("best.r1") != F.col("r1")) | (F.col("best.r2") != F.col("r2"))
    fate = out.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.when(lose, 0).otherwise(F.col("n")).alias(n)).where(F.col(n) != 1)
    judged = marked.join(fate, [r1, r2], "left").where(F.col(n).isNull() | (F.col(n) > 1))
    once = judged.where(F.col(n).isNull()).unionByName(judged.where(F.col(n) > 1).dropDuplicates([r1, r2]))
    return once.select(*(f"`{c}`" for c in docs.columns))
