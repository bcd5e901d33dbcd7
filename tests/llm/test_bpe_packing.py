import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodeplan.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    yield from ["", " ", "a", "\n\n  x", "it's We'll DON'T", "naïve café ÑANDÚ", "１２３ ٣٤", "日本語のテキスト", "\x1c\x1d\x85᠎ ", "🙂🙂‍👩", "<|endoftext|>", "a" * 9000, " " * 5000, "=" * 4097, "ab" * 6000]
    for _ in range(300):
        yield "".join(rng.choice(["the", "ou", " ", "\n", "é", "7", "!", "\t", chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))]) for _ in range(rng.randrange(60)))
    yield "".join(rng.choice("thersingouan") for _ in range(30_000))


def test_encoding_is_the_reference_encoding(reference):
    encoder = bpe.load(PATH, public_tokenizers.PATTERN)
    for text in texts():
        assert encoder.encode(text) == reference.encode_ordinary(text), text[:80]


def test_small_caches_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "STATES", 40)
    monkeypatch.setattr(bpe, "PAIRS", 60)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 160)
    encoder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in list(texts())[:120] + ["thersingouan" * 200]:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_streaming_decode_never_splits_a_character():
    encoder = bpe.load(PATH, public_tokenizers.PATTERN)
    for text in texts():
        decoder, out = bpe.Decoder(encoder.machine.vocab), []
        for i in encoder.encode(text):
            piece = decoder.feed([i])
            piece.decode()  # raises on half a character
            out.append(piece)
        assert (b"".join(out) + decoder.finish()).decode() == text


def test_half_a_character_is_held_and_bad_bytes_pass():
    assert [bpe.Decoder.incomplete(x) for x in (b"", b"a", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x99", b"\xc3\xa9", b"\xff", b"\x80\x80", b"\xf5")] == [0, 0, 1, 2, 3, 0, 0, 0, 0]


def test_digests_over_odd_rows(spark, reference):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (2, ""), (3, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 7, "decoy") for i, t in rows], "doc_id bigint, text string, n_tokens int, ids string")
    got = sorted(map(tuple, bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)

    def want(i, t):
        ids = reference.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert got == sorted((want(i, t) for i, t in rows), key=str)
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([1, 2, 7, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(80))]
        room, rows = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in range(len(room)) if room[r] >= lengths[i]]
            if not fits:
                room.append(size)
                rows.append([])
                fits = [len(room) - 1]
            least = min(room[r] for r in fits)
            room[[r for r in fits if room[r] == least][0]] -= lengths[i]
        got = packing.best_fit(lengths, size)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= size for r in got)
        assert sorted(size - sum(lengths[i] for i in r) for r in got) == sorted(room), "same rooms as the plain algorithm"


def test_packing_restores_every_document(spark, reference):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(400)))) for k in range(60)] + [(None, None), (7, "twice"), (7, "twice"), (99, "long " * 3000)]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id bigint, row string").repartition(3)
    packed = packing.pack(df, PATH, public_tokenizers.PATTERN, end=50256, seq_len=128, block_tokens=4000)
    got = packed.collect()
    for r in got:
        ids, pos, cuts = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert len(ids) == len(pos) == 128 and cuts[0] == 0 and cuts[-1] == r.n_tokens and cuts == sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            assert list(pos[a:b]) == list(range(b - a))
        assert all(ids[r.n_tokens :] == 50256) and len(r.doc_ids) == len(r.doc_offsets) == len(cuts) - 1
    assert len({(r.block, r.row) for r in got}) == len(got)
    back = sorted((str(s.doc_id), s.doc_offset, list(np.frombuffer(s.ids, "<u2"))) for s in packing.segments(packed).collect())
    want = sorted((str(i), a, [*reference.encode_ordinary(t or ""), 50256][a : a + 128]) for i, t in rows for a in range(0, len(reference.encode_ordinary(t or "")) + 1, 128))
    assert back == want
    assert packing.pack(df.limit(0), PATH, public_tokenizers.PATTERN, end=50256).count() == 0


def test_ids_beyond_16_bits(spark, reference):
    rows = [(1, "alpha beta"), (2, "gamma " * 300)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN, end=200_001, seq_len=64)
    assert all(len(r.input_ids) == 64 * 4 and r.id_bytes == 4 for r in packed.collect())
    back = {}
    for s in packing.segments(packed).orderBy("doc_id", "doc_offset").collect():
        back.setdefault(s.doc_id, []).extend(np.frombuffer(s.ids, "<u4").tolist())
    assert back == {i: [*reference.encode_ordinary(t), 200_001] for i, t in rows}


def test_rows_are_nearly_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH, public_tokenizers.PATTERN, end=50256).select("n_tokens").collect()
    assert sum(r[0] for r in rows) / (2048 * len(rows)) > 0.99


def test_columns_of_ids_and_back(spark, reference):
    rows = [(None, "é🙂 x"), (1, None), (1, ""), (2, "the end")]
    df = spark.createDataFrame([(t, i, "decoy") for i, t in rows], "text string, doc_id bigint, decoded string")
    got = bpe.encode(df, PATH, public_tokenizers.PATTERN, round_trip="same").collect()
    assert all(r.ids == reference.encode_ordinary(r.text or "") and r.same for r in got) and len(got) == 4
    back = bpe.decode(bpe.encode(df.drop("decoded"), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
