import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, simhash
from millrace.llm.runtime import Scratch

from .conftest import LONG


def groups(prints, bits):
    """Least member of each value's component, by comparing all pairs."""
    u = sorted(set(prints))
    x = np.array(u, np.int64).view(np.uint64)
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return {v: u[root(i)] for i, v in enumerate(u)}


def slow_fingerprint(text, width):
    import xxhash

    words = text.lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    for text in (b"", b" ", b"One", b"a b c", b"a b c d", b"A b\x0bC d a b c d a", "é ü ö".encode(), LONG.encode()[:3000]):
        assert simhash.fingerprint(text, 4) % 2**64 == slow_fingerprint(text, 4)
    # The hash is the one that Spark has.
    (h,) = spark.sql("SELECT xxhash64('one two three four')").first()
    assert simhash.fingerprint(b"one two three FOUR", 4) == h


@pytest.mark.parametrize("hot", [1000, 3])
@pytest.mark.parametrize("bits", [2, 4, 6])
def test_links_connect_what_all_pairs_do(spark, hot, bits):
    if (hot, bits) == (3, 6):
        pytest.skip("43,745 midpoints each")
    rng = random.Random(bits)
    prints = [0, -1]
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            prints.append(x - 2**64 if x >> 63 else x)
    prints += prints[:5]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, doc_id long").repartition(3)
    got = {r.fp: r.component_id for r in simhash.classes(Scratch(spark, "t"), df, bits, hot).collect()}
    expected = groups(prints, bits)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(expected[p], i)
    assert got == {p: first[expected[p]] for p in prints}


def test_components_of_chains_stars_and_circles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = components.components(Scratch(spark, "t"), df).collect()
    labels = {r.node: r.label for r in got}
    assert len(got) == len(labels) == 41 + 60 + 9
    assert [len({labels[i] for i in part}) for part in (range(41), range(100, 160), range(200, 209))] == [1, 1, 1]
    assert len(set(labels.values())) == 3
    assert components.components(Scratch(spark, "t"), df.limit(0)).collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    n = 5000
    df = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    scratch, saved = Scratch(spark, "t"), []
    scratch.save = lambda df, name, save=scratch.save: (saved.append(name), save(df, name))[1]
    got = components.components(scratch, df).collect()
    assert len(got) == n and len({r.label for r in got}) == 1
    assert sum(name.startswith("to") for name in saved) <= 30


def test_table(spark, table):
    docs = table("documents")
    got = simhash.simhash_components(spark, docs).toPandas().set_index("doc_id")
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 4) for r in docs.select("doc_id", "text").collect()}
    expected = groups(prints.values(), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(expected[prints[i]], i)
    assert len(got) == len(prints)
    for i, p in prints.items():
        assert (got.fingerprint[i], got.component_id[i]) == (f"{p % 2**64:016x}", least[expected[p]])


def test_edges(spark, edge, none):
    got = simhash.simhash_components(spark, edge).collect()
    assert len(got) == edge.count()
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[4].component_id == by_id[8].component_id == 4
    assert sorted(r.fingerprint for r in got if r.doc_id is None)[:2] == ["0" * 16] * 2
    assert simhash.simhash_components(spark, none).collect() == []


def test_kept_documents_have_no_close_copies(spark, table):
    docs = table("documents", "sf0.01")
    kept = simhash.keep_first(spark, docs).select("doc_id", "text").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    ids = {r.doc_id for r in kept}
    words = {i: frozenset(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in texts.items()}
    by_shingle = {}
    for i, w in words.items():
        for s in w:
            by_shingle.setdefault(s, []).append(i)
    pairs = {(a, b) for own in by_shingle.values() if len(own) < 100 for a in own for b in own if a < b}
    close = {p: len(words[p[0]] & words[p[1]]) / len(words[p[0]] | words[p[1]]) for p in pairs}
    # Nothing goes without a close copy, and hardly any pair stays whole.
    for i in set(texts) - ids:
        assert any(i in p and v >= 0.8 for p, v in close.items()) or len(texts[i].split()) < 5 or list(texts.values()).count(texts[i]) > 1
    high = [p for p, v in close.items() if v >= 0.8]
    both = [p for p in high if set(p) <= ids]
    assert high and len(both) <= 0.05 * len(high)


def test_bands_meet_as_often_as_they_should():
    rng = random.Random(9)
    for share, (low, high) in {0.9: (0.98, 1), 0.8: (0.95, 1), 0.5: (0.01, 0.25), 0.1: (0, 0.02)}.items():
        met = 0
        for _ in range(300):
            n = 100
            same = round(2 * share * n / (1 + share))
            a, b = (np.array([rng.getrandbits(64) for _ in range(k)], ">u8") for k in (n, n - same))
            x = a.view(np.uint8).reshape(-1, 8)
            y = np.r_[a[:same], b].astype(">u8").view(np.uint8).reshape(-1, 8)
            met += bool(set(simhash.bands(x, simhash.BANDS, simhash.BAND_HASHES)) & set(simhash.bands(y, simhash.BANDS, simhash.BAND_HASHES)))
        assert low <= met / 300 <= high
    assert simhash.bands(np.zeros((0, 8), np.uint8), 3, 2) == []


def test_similarity():
    assert simhash.similarity(b"a b c d e f", b"A b c d e f", 5) == 1
    assert simhash.similarity(b"a b c d e f", b"a b c d e g", 5) == 1 / 3
    assert simhash.similarity(b"", b" ", 5) == 1 and simhash.similarity(b"a", b"", 5) == 0 and simhash.similarity(b"a b", b"a b", 5) == 1


def test_keep_first(spark, edge, none):
    kept = simhash.keep_first(spark, edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 8 not in ids and 2 not in ids and 1 in ids and 6 in ids
    assert simhash.keep_first(spark, none).collect() == []


def first_of_groups(texts, bits=4, least=0.8):
    """Least id of each component, by comparing all pairs of texts."""
    prints = np.array([simhash.fingerprint(t.encode(), 5) for t in texts], np.int64).view(np.uint64)
    keys = np.array([simhash.bands(simhash._shingle_hashes(t.encode(), 5), simhash.BANDS, simhash.BAND_HASHES) for t in texts])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        near = (np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits) | (keys[i + 1 :] == keys[i]).any(axis=1)
        for j in np.flatnonzero(near) + i + 1:
            if root[i] != root[j] and simhash.similarity(texts[i].encode(), texts[j].encode(), 5) >= least:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


@pytest.mark.parametrize("bits, hot", [(8, None), (4, 20)])
def test_dense_near_copies_as_by_all_pairs(spark, monkeypatch, bits, hot):
    # Windows slide along a chain of words: only those a few steps apart are alike, yet all fingerprints are near.
    rng = random.Random(7)
    chains = [[f"w{rng.getrandbits(40)}" for _ in range(200)] for _ in range(6)]
    texts = [" ".join(["buy cheap pills here now"] * 12 + c[2 * i : 2 * i + 60]) for c in chains for i in range(40)]
    texts = list({simhash.fingerprint(t.encode(), 5): t for t in texts}.values())
    rng.shuffle(texts)
    want = first_of_groups(texts, bits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    if hot:
        monkeypatch.setattr(simhash, "hot_size", lambda bits: hot)
    assert sorted(r.doc_id for r in simhash.keep_first(spark, df, bits=bits).collect()) == want


def test_groups_that_are_not_alike_give_no_row_for_each_pair():
    """All in one band at a similarity of about 0.7, but for two pairs: links are fewer than members."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 84)
    sets = [np.unique(np.r_[base, rng.integers(-(2**63), 2**63 - 1, 16)]) for _ in range(300)]
    sets[7], sets[250] = sets[200][1:], np.r_[sets[3], 5]
    n = len(sets)
    columns = [np.full(n, simhash.BY_BAND), np.zeros(n), np.zeros(n), np.arange(n) * 1000, np.arange(n), np.arange(n)]
    names = ["way", "key", "root", "fp", "a", "label"]
    rows = pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(sets, pa.list_(pa.int64()))], [*names, "shingles"])
    for size in (300, 17):  # a group may span batches
        got = [r for b in simhash._inside(iter([rows.slice(i, size) for i in range(0, n, size)]), 4, 0.8) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in got) == [(3, 250), (7, 200)]


def test_equal_fingerprints_are_verified(spark):
    rng = random.Random(1)
    own = [[f"w{rng.getrandbits(40)}" for _ in range(60)] for _ in range(3)]
    texts = [" ".join(["buy cheap pills here now"] * 60 + words) for words in (own[0][:20], own[1][:40], own[2][:30], own[1][:41])]
    texts.append(texts[0].upper())
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts}) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(spark, df).collect()) == [0, 1, 2]
