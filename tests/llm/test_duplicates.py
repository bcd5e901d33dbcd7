"""Near duplicates, lines, components, archives and the pipeline against brute force and on odd rows."""

import base64
import gzip
import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from lodeplan.llm import common, graph, lines, neardup, oracles, warc


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 200)] + [(500, 501), (501, 502)], [(3, None), (None, 4), (5, 6)]])
def test_components(spark, links):
    union = Union()
    for a, b in links:
        if a is not None and b is not None:
            union.join(a, b)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: union.find(n) for n in list(union)}


# ------------------------------------------------------------------ hot keys


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_out(spark, how):
    keys = [1] * 4000 + [2] * 3000 + list(range(10, 3010)) + [None] * 5
    left = common.keep(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int"), "left")
    right = spark.createDataFrame([(k, f"r{k}") for k in [1, *range(10, 2000, 2), 9999]], "k int, r string")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_hot(left, right, ["k"], counts, how)
    assert sorted(map(tuple, got.select("k", "n", "r").collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("k", "n", "r").collect()), key=str)
    empty = common.join_hot(left.limit(0), right, ["k"], counts.limit(0), how)
    assert empty.columns == ["k", "n", "r"] and empty.count() == 0


def test_a_hot_key_lands_in_many_tasks(spark):
    left = common.keep(spark.createDataFrame([(1 if n % 2 else n,) for n in range(6000)], "k int"), "left")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("false", "-1", "16")):
            spark.conf.set(c, v)
        sizes = [r["count"] for r in common.join_hot(left, counts.select("k"), ["k"], counts).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    assert sum(sizes) == 6000 and max(sizes) < 1200


# ------------------------------------------------------------------ near duplicates


def shingles(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_neardup(rows, n=4):
    sets, union = [(i, shingles(t, n)) for i, t in rows], Union()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    return sorted((i, len(s), union.find(i), i == union.find(i)) for i, s in sets)


def family(rng, size, edits, words=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(own))
            rng.choice([lambda: own.pop(k), lambda: own.insert(k, f"x{rng.randrange(30)}"), lambda: own.__setitem__(k, "y")])()
        yield " ".join(own)


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    texts = [t for size, edits in ((120, 6), (40, 12), (3, 1), (2, 0), (60, 3)) for t in family(rng, size, edits)]
    texts += ["", None, " \n", "one", "ONE ", "one two three", "one two  three", "one two three four", "a b c d e f g h", "a b c d e f g h i"] + [f"solo {k} " * 9 for k in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(t, i, 5, "decoy") for i, t in rows], "text string, doc_id bigint, n int, bands string")
    want = brute_neardup(rows)
    assert sorted(map(tuple, neardup.digests(df).collect())) == want
    for n in (4, 5):
        kept = neardup.clean(df.withColumn("R1", F.lit(1)), shingle=n)
        assert kept.columns == [*df.columns, "R1"] and sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute_neardup(rows, n) if k]


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "x y z w"), (2, "p q r s"), (None, "lonely words are here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, neardup.clean(df).collect())) == Counter([(1, "a b c d e"), (2, "x y z w"), (2, "p q r s"), (None, "lonely words are here"), (None, None)])
    assert neardup.digests(df).count() == 7 and neardup.clean(df.limit(0)).count() == 0


def test_many_null_ids(spark):
    rows = [(None, f"text number {k // 2} of many words that no other has {k // 2}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert neardup.digests(df).count() == 3000 and neardup.clean(df).count() == 1500


def test_odd_sketches_bound_differences():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 2**64, 30, dtype=np.uint64)]))
        flipped = np.unpackbits((neardup.odd_sketch(x) ^ neardup.odd_sketch(y)).view(np.uint8)).sum()
        assert flipped <= len(np.setxor1d(x, y))


def test_near_duplicate_query(spark, duck):
    from lodeplan.llm import queries

    same(queries.op9_minmax(spark, SF), duck, oracles.NEAR_DUPLICATES)


# ------------------------------------------------------------------ lines


def normal(line):
    text = re.sub("[0-9]+", "0", line.lower())
    return " ".join("".join(c if c == "0" or unicodedata.category(c)[0] in "LM" else " " for c in text).split())


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def buckets(line):
    data = np.frombuffer(line.encode(), np.uint8)
    full, _, _, _, keys = lines.hashes(data, np.array([0, len(data)]))
    return set(keys.tolist()) if len(full) else set()


def near(a, b):
    if max(len(a), len(b)) > lines.LONG:
        a, b = a.split(" "), b.split(" ")
    most = int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def brute_lines(rows):
    """All pairs of classes that share a bucket, linked by edit similarity; test_recall judges the buckets."""
    first, of = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            key = normal(line)
            if key:
                first.setdefault(key, (i is None, i, n))
                of.setdefault(key, buckets(line))
    union, keys, shared = Union(), list(first), defaultdict(list)
    for k, a in enumerate(keys):
        union.find(a)
        for bucket in of[a]:
            shared[bucket].append(k)
    for k, j in {(k, j) for own in shared.values() for n, k in enumerate(own) for j in own[:n]}:
        if near(keys[k], keys[j]):
            union.join(keys[k], keys[j])
    groups = defaultdict(list)
    for key in keys:
        groups[union.find(key)].append(key)
    best = {key: min(first[k] for k in own) for own in groups.values() for key in own}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        own = t.split("\n")
        kept = [line for n, line in enumerate(own) if not normal(line) or best[normal(line)] == (i is None, i, n)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str), sum(len(g) > 1 for g in groups.values())


def test_lines_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    pool = [" ".join("word" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.choice([1, 2, 6, 60, 120]))) for _ in range(25)]

    def vary(line):
        words = line.split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["WORD7", "é", "99", "zz"])
        return rng.choice(["", "  ", "- "]) + " ".join(words).upper().replace("WORD", rng.choice(["word", "Word"])) + rng.choice(["", ".", "!!"])

    rows = [(k, "\n".join(vary(rng.choice(pool)) if rng.random() < 0.7 else rng.choice(["", "---", f"unique line number {rng.random()} of many words"]) for _ in range(rng.randrange(1, 12)))) for k in range(45)]
    rows += [(None, "last of all\n" + pool[3]), (100, None), (101, ""), (102, "\n\n"), (103, "5"), (104, "77"), (105, "x\n" * 500)]
    df = spark.createDataFrame([(t, i, "decoy", 7, "r") for i, t in rows], "text string, doc_id bigint, drops string, N_Lines_ int, r1 string")
    want, linked = brute_lines(rows)
    assert linked > 5
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.deduplicate(df).collect()), key=str)
    assert got == want
    kept = lines.clean(df)
    assert kept.columns == df.columns and kept.count() == sum(n == 0 or n < m for _, _, m, n in want)


def test_recall():
    """Of pairs of edit similarity 0.8 or more, made by changing lines of the documents, at least nine in ten share a bucket."""
    import duckdb

    rng = random.Random(10)
    pool = [r[0] for r in duckdb.sql(f"SELECT DISTINCT unnest(string_split(text, chr(10))) s FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]
    pool = [x for x in pool if normal(x) and len(x) < 900]
    words = [w for x in pool for w in x.split()]

    def replaced(x, n):
        own = x.split()
        for _ in range(n):
            own[rng.randrange(len(own))] = rng.choice(words)
        return " ".join(own)

    def typed(x):
        k = rng.randrange(len(x))
        return x[:k] + rng.choice("abcdefgh") + x[k + 1 :]

    for change in (lambda x: replaced(x, 1), lambda x: replaced(x, 2), typed):
        found = []
        for x in rng.sample(pool, 120):
            y = change(x)
            if normal(x) != normal(y) and near(normal(x), normal(y)):
                found.append(bool(buckets(x) & buckets(y)))
        assert len(found) > 60 and sum(found) >= 0.9 * len(found)


def test_lines_without_spaces_are_compared(spark):
    rng = random.Random(11)
    base = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(8)]
    near_ = [x[:20] + "世" + x[21:] for x in base]
    df = spark.createDataFrame([(0, "\n".join(base)), (1, "\n".join(near_))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dropped for r in lines.deduplicate(df).collect()} == {0: 0, 1: 8}


def test_folding_beyond_ascii():
    rng = random.Random(12)
    chars = ["a", "B", " ", "7", ".", "é", "É", "ß", "ẞ", "İ", "K", "“", "—", "\u00a0", "、", "中", "文", "e\u0301", "𝒜", "😀", "Ж", "ж", "²", "\u2028", "\x00"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(9))) for _ in range(3000)] + ["É", "é"]
    data, offsets = common.buffers(pa.array(texts))
    full, h1, h2, _, _ = lines.hashes(data, offsets)
    keys = [" ".join(re.sub("([中文])", r" \1 ", normal(t)).split()) for t in texts]  # spaces beside them don't count
    assert full.tolist() == [k for k, key in enumerate(keys) if key]
    of = {}
    for k, *h in zip(full.tolist(), h1.tolist(), h2.tolist()):
        of.setdefault(keys[k], set()).add(tuple(h))
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == len(of)


def test_lines_run_no_python(spark):
    """No operator of Python is in the plan, and the buckets are those of hashes() in plain Python."""
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randrange(1, 13))) for _ in range(300)] + ["Ünd", "12,5", "世", "ไทย", "中文字", "𝒜bcde", "😀", "x" * 50]
    own = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 9, 11, 30, 200, 1500]))) for _ in range(250)] + ["a", "...", "\x00", " ".join(["same"] * 9000)]
    df = spark.createDataFrame([(n, "\n".join(own[n::20])) for n in range(20)] + [(20, None)], "doc_id bigint, text string")
    seen = lines._occurrences(df, "doc_id", "text")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", "").replace("ExistingRDD", "")), plan
    got = defaultdict(lambda: [None, set()])
    for r in seen.collect():
        got[own[r.id :: 20][r.i]][0] = (r.h1, r.h2)
        got[own[r.id :: 20][r.i]][1] |= {*r["keys"]}
    data, offsets = common.buffers(pa.array(own))
    full, h1, h2, of, keys = lines.hashes(data, offsets)
    want = {own[n]: [(a, b), set(keys[of == k].tolist())] for k, (n, a, b) in enumerate(zip(full.tolist(), h1.tolist(), h2.tolist()))}
    assert len(want) > 150 and dict(got) == want


def test_code_of_the_line_hashes_comes_in_small_methods(spark):
    """Keys are made apart from the sums of votes, so no method that Spark makes for hashing has more than 5,000 bytes."""
    seen = lines._occurrences(spark.createDataFrame([(0, "some words\nof lines"), (1, None)], "doc_id bigint, text string"), "doc_id", "text")
    assert seen.count() == len(seen.collect()) > 1
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(seen._jdf.queryExecution().executedPlan())
    assert made.length() and max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.length())) <= 5000


def test_accented_and_typographic_variants_are_one_line(spark):
    pairs = [("Été à la plage", "ÉTÉ À LA PLAGE"), ("“Read more” — here", '"Read more" - here'), ("no\u00a0break", "no break"), ("你好、世界。", "你好 世界"), ("ЖУРНАЛ", "журнал")]
    df = spark.createDataFrame([(0, "\n".join(a for a, _ in pairs)), (1, "\n".join(b for _, b in pairs) + "\nete a la plage")], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_dropped, r.text) for r in lines.deduplicate(df).collect()} == {0: (0, "\n".join(a for a, _ in pairs)), 1: (5, "ete a la plage")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.deduplicate(empty).count() == 0 and neardup.digests(empty).count() == 0


def test_very_long_lines(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40_000)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(["some", "other", *words[2:]])), (2, "x" * 300_000), (3, "y" * 299_000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dropped for r in lines.deduplicate(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_lines_about_the_long_limit(spark):
    """One line of a pair beyond LONG characters, or long ones whose other words are of other lengths: still similar by words."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200)]
    below = " ".join(words[:64])
    above = " ".join([*words[:63], "x" * 12])
    long = " ".join(words[80:160])
    stretched = " ".join(["".join(rng.choice("abcdefgh") for _ in range(60)) if k < 6 else w for k, w in enumerate(words[80:160])])
    assert len(below) <= lines.LONG < len(above) and near(below, above)
    assert len(long) < 0.8 * len(stretched) and near(long, stretched)
    df = spark.createDataFrame([(0, below), (1, above), (2, long), (3, stretched)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dropped for r in lines.deduplicate(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_a_bucket_of_dissimilar_lines_keeps_no_pairs(spark, monkeypatch):
    """Lines of the same ten words beside others of three letters share all buckets: rows grow with lines, not with pairs."""
    rng = random.Random(14)

    def filler(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(n))

    same_words = " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(10))
    rows = [(k, f"{same_words} {filler(60)}") for k in range(150)]
    rows.append((200, rows[70][1][:-3] + "xyz"))  # similar to one, which is not the first
    rows.append((201, f"{same_words} {filler(105)}"))
    rows.append((202, rows[-1][1] + " xyz"))
    assert len(rows[-2][1]) <= lines.LONG < len(rows[-1][1])
    kept, keep = [], common.keep

    def counted(df, tag, codec=None):
        out = keep(df, tag, codec)
        kept.append((out.count(), tag))
        return out

    monkeypatch.setattr(common, "keep", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in lines.deduplicate(df).collect() if r.n_dropped} == {200, 202}
    assert max(kept)[0] <= 20 * len(rows), max(kept)


# ------------------------------------------------------------------ archives


def test_archives(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, f"http://Host{k % 3}.example.org:80/P{k % 5}?b=2&a={k % 2}", rng.choice(["<p>same</p>", f"<p>{k}</p>", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", None, "", "é" * k])) for k in range(60)]
    rows += [(None, "http://x.org/a b\n", "<p>same</p>"), (7, "http://y.org", "<p>same</p>"), (7, "http://y.org", "<p>same</p>"), (61, None, "z" * 300_000), (62, "http://[bad", "x")]
    df = spark.createDataFrame([(h, i, u, "decoy") for i, u, h in rows], "html string, page_id bigint, url string, record_type string").repartition(3)
    path = f"file://{tmp_path}/warc"
    got = warc.history(df, path).collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = min(best.get(h or "", i), i)

    def digest(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h in rows)
    assert all(r.refers_to is None for r in got if r.record_type == "response")
    by_digest = defaultdict(list)
    for r in got:
        by_digest[r.payload_digest].append(r)
    for h in {h or "" for _, _, h in rows}:
        own = by_digest[digest(h)]
        leads = [r for r in own if r.record_type == "response"]
        assert len(leads) == 1 and leads[0].page_id == best[h] and all(r.refers_to == best[h] for r in own if r.record_type == "revisit")
    order = [(r.urlkey, r.captured_at, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order), "globally in the order of the index"
    assert next(r for r in got if r.page_id == 0).urlkey == "org,example,host0)/p0?a=0&b=2"
    for f in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        for r in got:
            if r.file == f.name:
                record = data[r.offset : r.offset + r.length]
                assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
    assert warc.history(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    df = spark.createDataFrame([(k, "http://a.org", h) for k, h in enumerate(["", "", "big page", "big page"])], "page_id bigint, url string, html string")
    warc.write(warc.captures(df), f"file://{tmp_path}/w", min_bytes=5)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    assert got == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2)]


def test_damaged_archives_are_noticed():
    whole = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert [r[1] for r in warc.Records(whole)] == [b"abc"]
    for bad in (b"WARC/1.1\r\nContent-Length: 30\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nContent", b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.Records(gzip.compress(bad)))


def test_loser_tree():
    rng = random.Random(13)
    for k in range(9):
        runs = [sorted((rng.randrange(20), j) for _ in range(rng.randrange(12))) for j in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs], lambda row: row[0]))
        assert [x[0] for x in got] == sorted(x[0] for r in runs for x in r) and Counter(got) == Counter(x for r in runs for x in r)


def test_archive_query(spark, duck):
    from lodeplan.llm import queries

    same(queries.op7_warc(spark, SF), duck, oracles.WARC)


# ------------------------------------------------------------------ pipeline


def test_the_line_stage_leaves_little_on_disk(spark):
    """Of the scratch tables of the pipeline's second stage only the dropped lines stay for its result."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(k, f"line {k % 7} of some length that comes again\nand number x{k}y on its own here") for k in range(30)], "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    before = len(common._made)
    out = p.line_dedup(spark, docs, SF)
    left = [path.split("/")[-1].split("-")[0] for _, path in common._made[before:]]
    assert left.count("drops") == 1 and not {"lines", "classes", "buckets", "pairs", "open", "texts", "groups"} & set(left), left
    kept = common.keep(out, "kept")
    assert kept.count() == out.count() > 0
    common.discard(kept, docs)
    assert not common.exists(spark, kept._scratch)


def test_pipeline(spark):
    import corpus_pipeline as p
    from lodeplan.llm import bpe, decontaminate, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    tables, now = [docs], docs
    for name, stage in p.STAGES:
        from lodeplan.llm import common

        now = common.keep(stage(spark, now, SF), name)
        tables.append(now)
        if name != "byte_bpe":
            assert now.dtypes == docs.dtypes
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    judged = {r.doc_id for r in quality.judge(docs, ["doc_id"]).where("kept").collect()}
    assert ids[1] == judged
    want, _ = brute_lines([(r.doc_id, r.text) for r in tables[1].collect()])
    assert {(r.doc_id, r.text, r.n_chars) for r in tables[2].collect()} == {(i, t, len(t)) for i, t, m, n in want if n == 0 or n < m}
    near = brute_neardup([(r.doc_id, r.text) for r in tables[2].collect()], 5)
    assert ids[3] == {i for i, _, _, kept in near if kept}
    dirty = {r.doc_id for r in decontaminate.digests(tables[3], bench).where("contaminated").collect()}
    assert ids[4] == ids[3] - dirty
    encoder = bpe.load(p.public_tokenizers.path(p.TOKENIZER), p.public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    for r in tables[5].collect():
        assert r.ids == encoder.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert p.run(spark, SF).count() == tables[5].count()
