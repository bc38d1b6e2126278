import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import classlm


def expected(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tokens, held)]


def order(r):
    return (r[0] is None, r[0] or 0, r[2])


@pytest.mark.parametrize("dictionary", [131_072, 50])
def test_base_score(spark, table, monkeypatch, dictionary):
    monkeypatch.setattr(classlm.Vocabulary.__init__, "__defaults__", (dictionary, 1))
    docs = table("documents")
    got = classlm.class_lm_scores(spark, docs).toPandas().sort_values("doc_id")
    want = sorted(expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert list(zip(got.doc_id, got.held_out, got.n_tokens, got.n_known, got.train_tokens)) == [w[:5] for w in want]
    assert np.allclose(got.base_score, [w[5] for w in want], rtol=1e-9)
    assert (got.score < 0).all()


def test_class_model_is_better_than_its_base(spark, table):
    got = classlm.class_lm_scores(spark, table("documents")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert np.allclose(held.perplexity, 10 ** (-held.score / held.n_tokens))


def test_exchange_does_not_lower_the_likelihood():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 4, 60)
    pairs = rng.poisson(np.where(rng.random((4, 4)) < 0.4, 8, 0.2)[kind][:, kind])

    def likelihood(of, k):
        m = np.eye(k)[of]
        t = m.T @ pairs @ m
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    start = np.zeros(60, int)
    start[np.argsort(-pairs.sum(axis=1), kind="stable")] = np.arange(60) % 4
    values = [likelihood(classlm.exchange(pairs, 4, s), 4) for s in range(6)]
    assert values[0] == pytest.approx(likelihood(start, 4))
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:])) and values[-1] > values[0]


def tokens_of(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("dictionary", [131_072, 300])
def test_scores_by_hand(spark, table, monkeypatch, dictionary):
    """Every score again, from the texts and the words' classes alone."""
    held = []

    class Spy(classlm.ClassModel):
        def __init__(self, v, of, table):
            held.append((v, of, table))
            super().__init__(v, of, table)

    Spy.__module__, Spy.__qualname__ = "millrace.llm.classlm", "ClassModel"
    monkeypatch.setattr(classlm.Vocabulary.__init__, "__defaults__", (dictionary, 2))
    monkeypatch.setattr(classlm, "ClassModel", Spy)
    docs = table("documents")
    got = {r.doc_id: r.score for r in classlm.class_lm_scores(spark, docs).collect()}
    (v, of, seen) = held[0]
    kinds, kind = classlm.CLASSES + 2, dict(zip(v.words, of.tolist()))
    rows = [(r.doc_id, tokens_of(r.text)) for r in docs.collect()]
    train = [ws for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for ws in train for w in ws)
    often = {w for w, c in count.items() if c >= 2 or not w}
    assert len(v.words) <= dictionary * 1.1 and (set(kind) == often or dictionary == 300 and set(kind) < often)
    k = lambda w: kind.get(w, classlm.CLASSES + 1)
    pairs = Counter((k(a), k(b)) for ws in train for a, b in zip([b"", *ws], ws))
    assert {(a, b): int(seen[a, b]) for a, b in zip(*np.nonzero(seen))} == pairs
    total, size = Counter(), Counter(kind.values())
    for w, c in count.items():
        total[k(w)] += c
    size[classlm.CLASSES + 1] += 1
    rest = [c for w, c in count.items() if w not in kind]
    for i, ws in rows[:60]:
        want, last = 0.0, k(b"")
        for w in ws:
            c = k(w)
            follow = max(1, sum((last, d) in pairs for d in range(kinds)))
            single = (total[c] + 1) / (sum(total.values()) + kinds)
            want += math.log10((pairs[last, c] + follow * single) / (sum(pairs[last, d] for d in range(kinds)) + follow))
            if w in kind:
                want += math.log10((count[w] + 0.5) / (total[c] + 0.5 * size[c]))
            else:
                want += math.log10((count[w] + 1) / (sum(rest) + len(rest) + 1))
            last = c
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_probabilities_add_up():
    class V:
        n, other, other_n, other_v = np.arange(50) % 7, 50, 40, 9

    of = np.r_[8, np.random.default_rng(2).integers(0, 8, 49), 9]
    m = classlm.ClassModel(V, of, np.random.default_rng(1).poisson(0.3, (10, 10)).astype(float))
    assert np.allclose((10**m.step).sum(axis=1), 1)
    emit = 10**m.emit
    emit[50] *= V.other_n + V.other_v + 1  # the words beyond the dictionary and the unseen one share it
    assert np.allclose(np.bincount(of, weights=emit, minlength=10)[np.unique(of)], 1)


def encoded(spark, docs, scratch, size=131_072):
    words = spark.createDataFrame([(t,) for t in docs], "text string")
    counts = classlm.word_counts(words).cache()
    v = classlm.Vocabulary(counts, size)
    place = dict(zip(v.words, range(v.other)))
    ids = [(np.array([place.get(w, v.other) for w in tokens_of(t)], np.int32).tobytes(),) for t in docs]
    return v, classlm.Bigrams(scratch, spark.createDataFrame(ids, "ids binary").repartition(3), v)


def test_rounds_find_the_classes(spark):
    """Words of ten kinds that follow each other in a circle: hardly any is among the frequent ones."""
    rng = np.random.default_rng(3)
    docs = [" ".join(f"k{(s + i) % 10}w{int(rng.integers(60))}" for i in range(40)) for s in range(10) for _ in range(60)]
    v, b = encoded(spark, docs, classlm.Scratch(spark, "t"))
    of, seen = classlm.cluster(b, v, classes=10, frequent=60)
    kinds = [int(w[1:2]) for w in v.words[1:]]
    best = sum(max(Counter(of[1 + i] for i, k in enumerate(kinds) if k == kind).values()) for kind in range(10))
    assert best >= 0.95 * len(kinds) and len(set(of[1:-1].tolist())) == 10
    assert seen.sum() == sum(len(d.split()) + 1 for d in docs)


def test_gains_are_what_the_likelihood_gains(spark):
    rng = np.random.default_rng(4)
    docs = [" ".join(f"w{min(int(rng.zipf(1.4)), 99)}" for _ in range(30)) for _ in range(80)]
    v, b = encoded(spark, docs, classlm.Scratch(spark, "t"), 80)
    of = np.r_[5, rng.integers(0, 5, v.other - 1), 6]
    table = b.table(of, 7)
    row = b.rows.collect()
    for word in (1, 7, 40):
        if any(p >> 20 == word and p & (1 << 20) - 1 == word for r in row for p in classlm._unpacked(r.after)[0]):
            continue
        own, at = of[word], np.array([word])
        gain = sum(
            classlm._gains(*map(np.concatenate, zip(*(classlm._unpacked(getattr(r, side)) for r in row))), at, of, t, 5)[0]
            for side, t in (("after", table), ("before", table.T))
        )
        for to in range(5):
            moved = of.copy()
            moved[word] = to
            change = classlm.likelihood(b.table(moved, 7)) - classlm.likelihood(table)
            # What the word itself changes in its neighbours' sums is left out, so it is nearly the same.
            assert gain[to] - gain[own] == pytest.approx(change, rel=0.25, abs=6)


@pytest.mark.parametrize("size", [10, 64, 1000])
def test_dictionary_of_equally_frequent_words(spark, size):
    docs = [" ".join(f"w{i}" for i in range(lo, lo + 50)) for lo in range(0, 500, 50)] * 2 + ["x" * 100_000, "x" * 100_000]
    words = spark.createDataFrame([(t,) for t in docs], "text string")
    counts = classlm.word_counts(words)
    v = classlm.Vocabulary(counts, size)
    assert v.words[0] == b"" and b"x" * 100_000 not in v.words
    assert (0.3 * size < len(v.words) - 1 < 2.5 * size) if size < 500 else len(v.words) == 501
    assert v.tail(counts).count() == 502 - len(v.words) and v.other_v == 502 - len(v.words) == v.other_n / 2


def test_edges(spark, edge, none):
    got = classlm.class_lm_scores(spark, edge).collect()
    want = expected([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=order) == sorted((w[:5] for w in want), key=order)
    assert all(math.isfinite(r.score) for r in got)
    assert classlm.class_lm_scores(spark, none).collect() == []
    held = edge.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")
    alone = classlm.class_lm_scores(spark, held).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in alone)
