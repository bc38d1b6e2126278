"""Byte-level BPE encoding by backtracking, and decoding.

A piece's bytes are read as Latin-1 text, so that an Aho-Corasick automaton of
the vocabulary finds the longest token at each of its places in one pass. From
left to right the longest token is taken that goes with the one before; where
none does, the one before is given up for a shorter one, and its end is never
tried again. Two adjacent tokens go together if merging their joint bytes would
leave exactly these two. If all neighbours do, the sequence is the one that the
merges by rank give; so the time is linear in a piece's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .runtime import batch

_NEVER = 1 << 60
MEMO_PIECES = 200_000
MEMO_PAIRS = 500_000


def load(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a vocabulary file: a line for each, the bytes in base 64."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes a token, for all that merges make.

    Merging a token's own bytes by rank, with its own rank left out, ends at
    these two; a token for which it ends at more is never made by merging.
    """
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], _NEVER)
                if r < best:
                    best, at = r, i
            if at < 0 or best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Encoder:
    """Encodes pieces of text. Every single byte must be a token."""

    def __init__(self, tokens: list[tuple[bytes, int]], split: dict[int, tuple[int, int]]):
        self.ranks = dict(tokens)
        self.bytes_of = {r: t for t, r in tokens}
        self.merge = {pair: r for r, pair in split.items()}
        self.split = split
        made = {r for t, r in tokens if len(t) == 1} | set(split)
        self.automaton = ahocorasick.Automaton()
        for token, rank in tokens:
            if rank in made:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for token, rank in tokens:
            if rank in made:
                for n in range(len(token) - 1, 0, -1):
                    r = self.ranks.get(token[:n])
                    if r is not None and r in made:
                        self.shorter[rank] = r
                        break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.right = lru_cache(100_000)(lambda t: self._edge(t, 1))
        self.left = lru_cache(100_000)(lambda t: self._edge(t, 0))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is merged, with the rank at which each is merged on."""
        out = [(token, _NEVER)]
        while token in self.split:
            on = token
            token = self.split[token][side]
            out.append((token, on))
        return out[::-1]

    def together(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two adjacent tokens.

        Both sides of the border grow by merges of their own in order of rank.
        The border falls if at some time the tokens beside it make a pair whose
        rank comes before the next merge on either side; of equal ranks the
        leftmost merges first.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right = self.right(a), self.left(b)
        i = j = 0
        fine = True
        while True:
            (x, on_x), (y, on_y) = left[i], right[j]
            r = self.merge.get((x, y))
            if r is not None and r < on_x and r <= on_y:
                fine = False
                break
            if on_x == on_y == _NEVER:
                break
            if on_x <= on_y:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fine
        return fine

    def piece(self, data: bytes) -> list[int]:
        """Ranks of one piece's tokens."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size] = rank  # matches come by their ends, so longer ones later
        open_ends = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        shorter, length, together = self.shorter, self.bytes_of, self.together
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(length[token])
                if open_ends[end] and (last < 0 or together(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                less = shorter.get(token, -1)
                if less >= 0:
                    token = less
                    continue
                if last < 0:
                    raise ValueError("a byte is no token")
                open_ends[at] = 0
                out.pop()
                at -= len(length[last])
                token = last
                break
        return out


_HELD: dict[str, object] = {}


class Coder:
    """Encodes and decodes whole texts, with a memo of pieces of bounded size."""

    def __init__(self, tokens: list[tuple[bytes, int]], split: dict[int, tuple[int, int]], pattern: str):
        self.encoder = Encoder(tokens, split)
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def _piece(self, text: str) -> tuple[int, str, bytes]:
        ids = self.encoder.piece(text.encode())
        made = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(self.memo) >= MEMO_PIECES:
            self.memo.clear()
        if len(text) <= 64:
            self.memo[text] = made
        return made

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encoder.piece(p.encode())]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids joined by commas and of the decoded bytes."""
        ids, back, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
        memo, make = self.memo.get, self._piece
        found = self.pieces(text)
        for lo in range(0, len(found), 20_000):
            made = [memo(p) or make(p) for p in found[lo : lo + 20_000]]
            n += sum([m[0] for m in made])
            ids.update(("" if first else ",").encode() + ",".join([m[1] for m in made]).encode())
            back.update(b"".join([m[2] for m in made]))
            first = False
        return n, ids.hexdigest(), back.hexdigest()


def coder(spark: SparkSession, path: str, pattern: str):
    """A broadcast of what a worker needs to build a Coder; the vocabulary's size bounds it."""
    if path not in _HELD:
        tokens = load(path)
        _HELD[path] = (tokens, halves(dict(tokens)))
    tokens, split = _HELD[path]
    return spark.sparkContext.broadcast((path, tokens, split, pattern))


def on_worker(shared) -> Coder:
    """The Coder of this worker process, built once and kept for later tasks."""
    path, tokens, split, pattern = shared.value
    key = f"{path} {pattern}"
    if not isinstance(_HELD.get(key), Coder):
        _HELD[key] = Coder(tokens, split, pattern)
    return _HELD[key]


def _digests(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    own = on_worker(shared)
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            rows = [own.digests(t or "") for t in part.column("text").to_pylist()]
            yield batch(schema, part.column("doc_id"), *zip(*rows))


def encode_digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes documents (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; their digests are those of nothing.
    Every row gives a row, also if rows repeat. Special tokens aren't known.
    """
    shared = coder(spark, path, pattern)
    return docs.select("doc_id", "text").mapInArrow(
        lambda x: _digests(x, shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _ids(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    own = on_worker(shared)
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            yield batch(schema, part.column("doc_id"), [own.encode(t or "") for t in part.column("text").to_pylist()])


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text)."""
    shared = coder(spark, path, pattern)
    return docs.select("doc_id", "text").mapInArrow(lambda x: _ids(x, shared), "doc_id long, ids array<int>")


def decode(spark: SparkSession, tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) of (doc_id, ids): the tokens' bytes. Null ids are empty."""
    shared = coder(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])
        own = on_worker(shared)
        for b in batches:
            yield batch(schema, b.column("doc_id"), [own.decode(x or []) for x in b.column("ids").to_pylist()])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
