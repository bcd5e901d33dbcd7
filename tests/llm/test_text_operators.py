"""Decontamination, secrets, licenses, quality and toxicity against brute force and on odd rows."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from lodeplan.llm import common, decontaminate, licenses, oracles, quality, secrets, toxicity

ODD = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, "word " * 30_000, "en", None), (4, "x", "xx", "b"), (5, "\x00null éÉ ퟿", "en", "a")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "decoy", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_words string, kept int")


# ------------------------------------------------------------------ words


def test_words_are_those_of_the_patterns():
    rng = random.Random(0)
    own = ["".join(rng.choice(["a", "Z", "é", "É", " ", "\n", "\x0b", "\x00", "9", "_", "中", "-"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    for kinds, pattern in ((common.SPACES, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = common.buffers(pa.array([*own, None]))
        words = common.Words(data, offsets, kinds)
        for row, text in enumerate([*own, ""]):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            want = [m.span() for m in re.finditer(pattern, low)]
            got = [(int(words.starts[k] - offsets[row]), int(words.ends[k] - offsets[row])) for k in range(words.first[row], words.first[row + 1])]
            assert got == [tuple(len(low[:x].encode()) for x in s) for s in want]
        by_text = {}
        for k, h in enumerate(words.hashes):
            by_text.setdefault(words.bytes[words.starts[k] : words.ends[k]].tobytes(), set()).add(int(h))
        assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)


# ------------------------------------------------------------------ decontamination


def brute_decontamination(docs, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_decontamination(spark, item_bytes):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(40)] + ["É", "über"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 5, 9, 10, 11, 14, 30]))) for k in range(25)] + [(3, "w1 w2 w3"), (None, "lone item of four words here"), (77, None), (78, "!!"), (79, "w5")]
    docs = [(k, ", ".join([say(rng.randrange(40)), (rng.choice(items)[1] or "").upper() if k % 2 else "", say(rng.randrange(40))])) for k in range(60)] + [(None, None), (1, ""), (1, "")]
    df = spark.createDataFrame([(t, i, "z") for i, t in docs], "text string, doc_id bigint, hit_items string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    found = decontaminate.find(df, bench, item_bytes=item_bytes)
    assert found.columns == ["text", "doc_id", "hit_items", "n_words", "hit_ranges", "hit_items_"]
    got = []
    for r in found.collect():
        spans = list(zip(r.hit_ranges[::2], r.hit_ranges[1::2]))
        assert all(a < b for a, b in spans) and all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))
        got.append((r.doc_id, r.n_words, sum(b - a for a, b in spans), len(r.hit_items_), hashlib.sha256(",".join(r.hit_items_).encode()).hexdigest(), bool(spans)))
    assert sorted(got, key=str) == brute_decontamination(docs, items, 10)
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id or -1 for r in clean.collect()) == sorted(g[0] or -1 for g in got if not g[5])
    assert decontaminate.digests(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digests(df, bench.limit(0)).collect())


def test_the_index_of_items_stays_small():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 11))) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=80)) for _ in range(1500)]
    index = decontaminate.Index(pa.table({"i": pa.array(map(str, range(1500))), "t": pa.array(texts)}), 10, 5)
    shingles = index.all_shingles()
    index.order(shingles, {k: np.ones(len(v), np.int64) for k, v in shingles.items()})
    assert len(index.begin) == 1500 * 71 and len(pickle.dumps(index)) < 12 * sum(map(len, texts))


def test_items_that_share_windows(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    bench = spark.createDataFrame([(k, f"{shared} own{k}") for k in range(300)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"x {shared} y {shared}"), (2, f"{shared} own7 z"), (3, shared[:-4])], "doc_id int, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digests(docs, bench).collect()}
    assert got == {1: (24, 300), 2: (13, 300), 3: (11, 300)}


def test_decontamination_query(spark, duck):
    from lodeplan.llm import queries

    same(queries.op2_decontaminate(spark, SF), duck, oracles.DECONTAMINATE)


# ------------------------------------------------------------------ secrets


def brute_secrets(text):
    spans = []
    for k, (name, pattern, group, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))


def test_secrets(spark, tmp_path):
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apikey", " ", ":", "=", '"', "'", "AKIA", "ABCDEFGHIJKLMN12", "deadbeefdeadbeef0", "0123456789abcde", "é🙂", "\n", "Zz_9.-+/=", "aa", "token=secret:abcdefghijklm", "x" * 13]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for k in range(300)] + [(None, None), (1, ""), (2, "token: " + "a" * 100_000)]
    rows += rows[:10]
    df = spark.createDataFrame([(t, i, "decoy") for i, t in rows], "text string, doc_id bigint, spans string")
    got = sorted(((r.doc_id, r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.digests(df, f"file://{tmp_path}/a").collect()), key=str)
    want = sorted(((i, s, hashlib.sha256(s.encode()).hexdigest(), s.count("assign"), s.count("access"), s.count("hex")) for i, t in rows for s in [brute_secrets(t)]), key=str)
    assert got == want
    assert secrets.digests(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_the_ledger_scans_only_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([("a", "token=abcdefghijklmnop"), ("b", "nothing"), ("c", "nothing")], "path string, text string")
    assert secrets.scan(first, path).select("blob").distinct().count() == 2
    n = spark.read.parquet(path).count()
    assert secrets.scan(first, path).count() == n, "all known"
    second = first.union(spark.createDataFrame([("a", "token=abcdefghijklmnop2"), ("d", "nothing")], "path string, text string"))
    assert secrets.scan(second, path).count() == n + 1, "one new version of a; d is a known blob"
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{3,}"))
    ledger = secrets.scan(second, path, rules=newer)
    again = ledger.where(F.array_contains("scanned", "hex@2"))
    assert again.select("blob").distinct().count() == 3 and again.where(F.array_contains("scanned", "assign@1")).count() == 0
    found = {(r.path, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets.findings(second, ledger, ["path"], rules=newer).collect()}
    assert ("d", ()) in found and ("a", (("assign", 0, 22), ("hex", 6, 12))) in found


def test_findings_beside_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b1", 1, "AKIA" + "Q" * 16), ("a", "b1", 1, "AKIA" + "Q" * 16), ("c", None, None, None)], "path string, blob string, spans int, text string")
    got = secrets.findings(rows, secrets.scan(rows, f"file://{tmp_path}/a"), ["path", "blob", "spans"])
    assert got.columns == ["path", "blob", "spans", "blob_", "spans_"]
    assert sorted((r.path, r.blob, r.spans, len(r.spans_)) for r in got.collect() if r.blob) == [("a", "b1", 1, 1)] * 2 and got.count() == 3


def test_secrets_query(spark, duck):
    from lodeplan.llm import queries

    same(queries.op3_secrets(spark, SF), duck, oracles.SECRETS)


# ------------------------------------------------------------------ licenses


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y >= 0 else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_common_subsequences():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice(range(-1, rng.choice([3, 8, 40]))) for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] >= 0 for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
    for _ in range(60):
        a, b = rng.sample(range(30), 25), rng.sample(range(30), 25)
        assert len(licenses.align(a, b)) == longest_common(a, b), "with no repeats the rising subsequence is the longest"
    assert len(licenses.align([1] * 900, [1] * 800)) == 800 and len(licenses.align([1, 2] * 300, [2, 1] * 300)) >= 1


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    words = mit.split()
    noisy = " ".join(w for k, w in enumerate(words) if k % 9) + " and more"
    filler = "the of and to a in software is with " * 400
    cases = {
        1: (f"{filler}\n// {mit}\n{filler}", [("MIT", 1.0)]), 2: (noisy, [("MIT", None)]), 3: (" ".join(words[: len(words) // 2]), []),
        4: (f"{apache} {filler} all RIGHTS, reserved {filler} ALL rights reserved.", [("Apache-2.0-header", 1.0), ("all-rights-reserved", 1.0), ("all-rights-reserved", 1.0)]),
        5: (filler, []), 6: ("", []), 7: (None, []), 8: ("Licensed under the Apache License, Version 2.0.", [("Apache-2.0-notice", 1.0)]), 9: ("été — Released under the MIT License", [("MIT-notice", 1.0)]),
    }
    df = spark.createDataFrame([(t, i, "decoy") for i, (t, _) in cases.items()] + [("All rights reserved", None, ""), ("All rights reserved", None, "")], "text string, doc_id bigint, licenses string")
    got = licenses.scan(df).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r.doc_id is None:
            assert r.best_license == "all-rights-reserved"
            continue
        text, want = cases[r.doc_id]
        assert [x.name for x in r.licenses] == [n for n, _ in want], r.doc_id
        assert all(c is None or x.coverage == c for x, (_, c) in zip(r.licenses, want)) and r.n_licenses == len(want)
    one = next(r for r in got if r.doc_id == 9).licenses[0]
    assert cases[9][0][one.char_start : one.char_end] == "Released under the MIT License"
    assert licenses.scan(df.limit(0)).count() == 0


def found_licenses(text):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    (_, found), = scanner.chunk(*common.buffers(pa.array([text])))
    return [(f[0], f[1], text[f[4] : f[5]]) for f in found]


def test_licenses_beside_noise_and_each_other():
    notice, mit = "All rights reserved", licenses.TEMPLATES["MIT"].rstrip(".")
    words = mit.split()
    for gap in range(14):
        assert found_licenses(f"all {'x ' * gap}{notice} {'y ' * gap}reserved") == [("all-rights-reserved", 1.0, notice)], gap
    assert [c for _, c, _ in found_licenses(f"{notice}. {notice}. rights {notice}")] == [1.0] * 3
    for lost in (1, len(words) // 2, len(words) - 1):
        less = " ".join(words[:lost] + words[lost + 1 :])
        for text in ([less, mit], [mit, less], [less, less, less], [mit, "permission of software", less, notice, mit]):
            got = found_licenses(" . ".join(text))
            assert [n for n, _, _ in got] == ["all-rights-reserved" if x == notice else "MIT" for x in text if "of software" not in x or len(x) > 30], (lost, text)
            assert all(c >= licenses.COVERAGE for _, c, _ in got)


# ------------------------------------------------------------------ quality


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    runs, again = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if runs[tuple(w[k : k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_statistics(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice(["a", "b ", "c\n", "#", "é ", "\t", " \n", "$x ", "\x0c", "dd "]) for _ in range(rng.randrange(200))), "en", "s") for k in range(150)]
    rows += [(k, t, la, s) for k, t, la, s in ODD if t is None or "퟿" not in t]
    df = docs_of(spark, rows)
    got = sorted((tuple(r) for r in quality.judge(df.select("doc_id", "text", "lang", "source"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(((i, *brute_quality(t)) for i, t, _, _ in rows), key=str)


def brute_mcd(x):
    """The same steps in numpy for one group; x in SCALE units."""
    floor = np.array(list(quality.DIMENSIONS.values()))

    def middle(v):
        values, counts = np.unique(v, return_counts=True)
        return values[np.flatnonzero(2 * np.cumsum(counts) >= len(v))[0]]

    coarse = np.floor(x / 16).astype(int)
    mid = np.array([middle(c) for c in coarse.T])
    mad = np.array([middle(np.abs(c - m)) for c, m in zip(coarse.T, mid)])
    mean, factor = (mid + 0.5) * 16 / quality.SCALE, np.diag(np.sqrt((mad * 16 / quality.SCALE * 1.4826) ** 2 + floor**2))
    distance = lambda: (np.linalg.solve(factor, (x / quality.SCALE - mean).T) ** 2).sum(0)
    for _ in range(quality.STEPS):
        bins = np.floor(np.log1p(distance()) * quality.BINS)
        values, counts = np.unique(bins, return_counts=True)
        near = x[bins <= values[np.flatnonzero(np.cumsum(counts) >= quality.SUPPORT * len(x))[0]]] / quality.SCALE
        mean = near.mean(0)
        factor = np.linalg.cholesky(np.cov(near.T, bias=True) / quality._CONSISTENCY + np.diag(floor**2))
    return distance()


def test_outliers_are_those_of_the_plain_algorithm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one"))
    judged = quality.judge(docs, ["doc_id", "lang"]).toPandas()
    rows = quality._vector(quality.statistics(docs, ["doc_id", "lang"])).toPandas()
    names, seen = list(quality.DIMENSIONS), 0
    for lang, own in rows[~rows.base_failed].groupby("lang"):
        if len(own) < quality.MIN_GROUP:
            continue
        want = dict(zip(own.doc_id, brute_mcd(own[names].to_numpy(float))))
        for r in judged[(judged.lang == lang) & ~judged.base_failed].itertuples():
            assert r.distance == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-6) and r.kept == (want[r.doc_id] <= quality.CUTOFF)
            seen += 1
    assert seen > 500
    assert not judged[judged.base_failed].kept.any()


def test_much_junk_does_not_hide_itself(spark):
    """Two in five texts of a source are junk of one kind, and one source has a single text, also junk."""
    rng = random.Random(3)

    def text(junk):
        return " ".join(("###$$$***" if junk and rng.random() < 0.5 else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(90, 160)))

    rows = [(k, text(k % 5 < 2), "en", "a") for k in range(300)] + [(300, text(True), "en", "rare"), (301, text(False), "en", "rare")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), ["doc_id"]).collect()}
    assert kept == {k: k % 5 >= 2 for k in range(300)} | {300: False, 301: True}


def test_quality_keeps_good_and_rejects_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id"]).join(labels, "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.all() and not rows[rows.quality == 0].kept.any()


def prose(rng, junk=False, words=90):
    own = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(words + rng.randrange(30))]
    return " ".join(w + "#$%&|<>*" * 4 if junk else w for w in own)


def test_small_groups_are_judged_by_their_language_or_by_all(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng), "en", "large") for k in range(60)]
    rows += [(100, prose(rng, True), "en", "one"), (101, prose(rng), "en", "other"), *((k, prose(rng, k > 111), "en", "few") for k in (110, 111, 112))]
    rows += [(200, prose(rng, True), "xx", "one"), (201, prose(rng), "yy", None), (202, prose(rng, True), None, None)]
    judged = quality.judge(docs_of(spark, rows).select("doc_id", "text", "lang", "source"), ["doc_id"]).collect()
    assert len(judged) == len(rows) and not any(r.base_failed for r in judged)
    assert {r.doc_id for r in judged if not r.kept} == {100, 112, 200, 202}


def test_quality_on_odd_tables(spark):
    df = docs_of(spark, [r for r in ODD if r[1] is None or "퟿" not in r[1]])
    assert {(r.doc_id, r.kept) for r in quality.judge(df.select("doc_id", "text", "lang", "source"), ["doc_id"]).collect()} >= {(None, False), (1, False)}
    assert quality.clean(df).columns == df.columns and quality.clean(df.limit(0)).count() == 0
    same_rows = docs_of(spark, [(k % 3, " ".join(f"w{j}" for j in range(80)), "en", "a") for k in range(120)])
    assert quality.clean(same_rows).count() == 120


# ------------------------------------------------------------------ toxicity


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    scores, toxic = rows.score.to_numpy(), rows.toxic.to_numpy() == 1
    ranks = scores.argsort().argsort()
    auc = (ranks[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum()
    assert auc > 0.95 and ((scores >= 0.3) & toxic).sum() / toxic.sum() > 0.8 and (scores >= 0.3)[~toxic].mean() < 0.05
    assert (rows.predicted == (rows.score >= 0.3)).all()
    odd = docs_of(spark, [r for r in ODD if r[1] is None or "퟿" not in r[1]])
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(60)], "doc_id bigint, text string")
    flip = lambda shift: spark.createDataFrame([(k, (k + (shift if zlib.crc32(str(k).encode()) % 4 == 2 else 0)) % 2) for k in range(60)], "doc_id bigint, toxic int")
    a, b = (toxicity.fit(docs, flip(s)) for s in (0, 1))
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, None)], 0.0)])
def test_toxicity_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert toxicity.score(docs, model).first().score == pytest.approx(score)
