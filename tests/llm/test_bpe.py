import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe

from .conftest import LONG

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def coder():
    tokens = bpe.load(PATH)
    return bpe.Coder(tokens, bpe.halves(dict(tokens)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.load(PATH)), special_tokens={})


def test_as_the_library(coder, library, table):
    for r in table("documents").select("text").collect():
        ids = coder.encode(r.text)
        assert ids == library.encode_ordinary(r.text)
        assert coder.decode(ids).decode() == r.text


def test_random_texts(coder, library):
    rng = random.Random(2)
    alphabets = ["abcdeth  ", "éèçñß", "0123456789", "日本語한국어", "\n\t .,'!-_aAeE", "😀🎉", "   ", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, rng.choice([3, 8, 20, 60]))))
        assert coder.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000, "é" * 2000, LONG):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_pairs_as_merging(coder):
    """Two tokens go together exactly if merging their bytes gives them back."""
    rng = random.Random(3)
    encoder = coder.encoder
    ids = list(encoder.bytes_of)
    seen = set()
    for _ in range(4000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        parts = [bytes([x]) for x in encoder.bytes_of[a] + encoder.bytes_of[b]]
        while len(parts) > 1:
            rank, i = min((encoder.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        fine = [encoder.ranks[p] for p in parts] == [a, b]
        assert encoder.together(a, b) == fine
        seen.add(fine)
    assert seen == {True, False}


def test_memo_is_bounded(coder, monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 10)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 10)
    text = LONG[:3000]
    assert coder.digests(text)[0] == len(library.encode_ordinary(text))


def test_query(spark, edge, none, library):
    rows = edge.select("doc_id", "text").collect()
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.encode_digests(spark, edge, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_digests(spark, none, PATH, public_tokenizers.PATTERN).collect() == []


def test_encode_and_decode(spark, edge):
    ids = bpe.encode(spark, edge, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(spark, ids, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((r.text or "").encode() for r in edge.select("text").collect())
