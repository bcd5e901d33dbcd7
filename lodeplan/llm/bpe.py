"""Byte-level BPE by a lazily determinised finite-state transducer (operator 8).

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair of tokens is the
encoding of the pair's bytes.  So the merges compile into a finite-state machine: it guesses at every
byte that a token starts there, follows all guesses along the trie of the vocabulary at once, and
closes a token wherever the pair with the token before it is stable.  ``Transducer`` determinises
that machine only where the data goes: a deterministic state is the set of live trie nodes with the
tokens that may end there, and the memory beside it is the last token of each prefix, of which there
is exactly one.  A token is emitted once all live guesses agree on it: as soon as no guess but a fresh
one is alive, at the latest when LOOKAHEAD more bytes are read.

``Decoder`` is the way back: ids in, whole characters out, with an incomplete UTF-8 sequence held over.

Edge cases: null and empty texts have no tokens (the hash of no bytes); any text however long is one
row, read piece by piece; rows with equal or null ids are separate rows; an empty table gives an
empty table; columns of the input other than the text are carried along or, in ``digests``, ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Of one worker: entries of the piece cache, states of the machine and pairs known before each starts anew.
PIECES, STATES, PAIRS = 120_000, 100_000, 500_000
#: Bytes after which tokens that all live guesses agree on are emitted at the latest.
LOOKAHEAD = 4096
_NONE, _DEAD = -1, -2


class Transducer:
    """encode(piece) is what the merges in order of rank make of the piece's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [_NONE]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.token)
                    self.children.append({})
                    self.token.append(_NONE)
                node = nxt
            self.token[node] = rank
        self._forget()

    def _forget(self) -> None:
        self._states: list[tuple[int, ...]] = [(0,)]
        self._ends: list[list[tuple[int, int]]] = [[]]
        self._ids: dict[tuple[int, ...], int] = {(0,): 0}
        self._step: dict[int, int] = {}
        self._after: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._pairs = 0

    def merge(self, word: bytes) -> list[int]:
        """The merges applied literally: the definition, used on vocabulary pairs only."""
        get, none = self.ranks.get, 1 << 60
        cuts, pairs = list(range(len(word) + 1)), [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(word[cuts[i] : cuts[i + 2]], none)
        return [self.ranks[word[i:j]] for i, j in zip(cuts, cuts[1:])]

    def stable(self, a: int, b: int) -> bool:
        """Whether b can follow a (a is _NONE at the start of a piece: then, whether b encodes to itself)."""
        known = self._after[a].get(b)
        if known is None:
            if a == _NONE:
                known = self.merge(self.vocab[b]) == [b]
            else:
                known = self.stable(_NONE, b) and self.merge(self.vocab[a] + self.vocab[b]) == [a, b]
            self._pairs += 1
            self._after[a][b] = known
        return known

    def _advance(self, state: int, byte: int) -> int:
        """The live trie nodes after one more byte, longest first, a fresh start always last."""
        live = (*(n for n in (self.children[m].get(byte) for m in self._states[state]) if n is not None), 0)
        nxt = self._ids.get(live)
        if nxt is None:
            nxt = self._ids[live] = len(self._states)
            self._states.append(live)
            self._ends.append([(t, self.length[t]) for t in (self.token[n] for n in live) if t != _NONE and self.stable(_NONE, t)])
        self._step[state << 8 | byte] = nxt
        return nxt

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self._states) > STATES or self._pairs > PAIRS:
            self._forget()
        step, ends, after = self._step, self._ends, self._after
        state, last, follow, out, at = 0, [_NONE], [after[_NONE]], [], 0
        for byte in piece:
            nxt = step.get(state << 8 | byte)
            state = self._advance(state, byte) if nxt is None else nxt
            at += 1
            for token, size in ends[state]:
                known = follow[at - size]
                if known is None:
                    continue
                fits = known.get(token)
                if self.stable(last[at - size], token) if fits is None else fits:
                    last.append(token)
                    follow.append(after[token])
                    break
            else:
                last.append(_DEAD)
                follow.append(None)
            if at >= LOOKAHEAD:
                kept = self._agreed(state, last)
                if kept:
                    out += self._back(last, kept)
                    del last[:kept], follow[:kept]
                    at -= kept
        return (*out, *self._back(last, at))

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the prefix that ends at byte at."""
        out = []
        while at:
            token = last[at]
            if token == _DEAD:
                raise ValueError("no encoding: the ranks don't hold all single bytes")
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def _agreed(self, state: int, last: list[int]) -> int:
        """The furthest byte through which the encodings of all live prefixes pass."""
        ats = {len(last) - 1 - self._depth(n) for n in self._states[state]}
        ats = {at for at in ats if last[at] != _DEAD}
        while len(ats) > 1:
            far = max(ats)
            ats.remove(far)
            ats.add(far - self.length[last[far]])
        return min(ats, default=0)

    def _depth(self, node: int) -> int:
        depths = self.__dict__.setdefault("_depths", [])
        if not depths:
            depths += [0] * len(self.token)
            for n, kids in enumerate(self.children):
                for k in kids.values():
                    depths[k] = depths[n] + 1
        return depths[node]


class Encoder:
    """Texts to ids: the pattern's matches one after another, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int | None = None):
        import regex

        self.pieces = pieces or PIECES

        # the regex module's \s also has U+001C..1F, which White_Space lacks
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.machine = Transducer(ranks)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def _miss(self, piece: str) -> tuple[int, ...]:
        got = self.older.get(piece) or self.machine.encode(piece.encode())
        if len(piece) <= 40:
            if len(self.cache) >= self.pieces:
                self.cache, self.older = {}, self.cache
            self.cache[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.find(text):
            ids += self.cache.get(piece) or self._miss(piece)
        return ids


class Decoder:
    """feed(ids) returns the bytes of all characters that are complete by now; finish() what is left over."""

    def __init__(self, vocab: dict[int, bytes]):
        self.vocab, self.held = vocab, b""

    @staticmethod
    def incomplete(data: bytes) -> int:
        """How many bytes at the end of data begin a UTF-8 sequence that goes on."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b & 0xC0 == 0x80:
                continue
            need = 1 if b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
            return k if need > k else 0
        return 0

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + b"".join(map(self.vocab.__getitem__, ids))
        k = self.incomplete(data)
        self.held = data[len(data) - k :]
        return data[: len(data) - k]

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


_loaded: dict[tuple, Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load(path: str, pattern: str, pieces: int | None = None) -> Encoder:
    """The encoder of a rank file, once for each Python worker."""
    if (path, pattern, pieces) not in _loaded:
        _loaded[path, pattern, pieces] = Encoder(read_ranks(path), pattern, pieces)
    return _loaded[path, pattern, pieces]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """docs with a column of token ids; with round_trip, also whether they decode to the text's bytes."""
    common.small_batches(docs.sparkSession)
    schema = common.extended(docs, (ids, "array<int>"), *([(round_trip, "boolean")] if round_trip else []))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        vocab = encoder.machine.vocab
        for batch in batches:
            own, exact = [], []
            for value in batch.column(at):
                t = value.as_py() or ""
                found = encoder.encode(t)
                own.append(np.array(found, np.int32))
                if round_trip:
                    decoder = Decoder(vocab)
                    exact.append(decoder.feed(found) + decoder.finish() == t.encode())
            cuts = np.cumsum([0, *map(len, own)], dtype=np.int32)
            out = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*own, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, out, *([pa.array(exact, pa.bool_())] if round_trip else [])], schema.names)
        encoder.forget()  # what the next task of this worker may not need

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes that a column of ids stands for (null ids: no bytes)."""
    common.small_batches(rows.sparkSession)
    schema = common.extended(rows, (decoded, "binary"))
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {i: b for b, i in read_ranks(path).items()}
        for batch in batches:
            out = []
            for value in batch.column(at):
                decoder = Decoder(vocab)
                out.append(decoder.feed(value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else ()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """For each row: key, n_tokens, the SHA-256 of its decimal ids joined by commas, and of the decoded bytes.
    pieces: entries of each worker's piece cache, about 250 bytes each."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern, pieces)
        vocab = encoder.machine.vocab
        decimal = {i: str(i) for i in vocab}
        for batch in batches:
            n, hashes, back = [], [], []
            for value in batch.column(1):
                ids = encoder.encode(value.as_py() or "")
                n.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoder, seen = Decoder(vocab), hashlib.sha256()
                for i in range(0, len(ids), 4096):
                    seen.update(decoder.feed(ids[i : i + 4096]))
                seen.update(decoder.finish())
                back.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
