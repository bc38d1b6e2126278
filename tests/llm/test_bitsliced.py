import math
import random

import numpy as np
import pytest

from millrace.llm import bitsliced


def expected(rows, k, every):
    data = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(data):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(data) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, row int, part string").repartition(3)
    return sorted(map(tuple, bitsliced.top_k(spark, df, k, every).collect()))


@pytest.mark.parametrize("block", [32_768, 64])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 5)
    rng = np.random.default_rng(block)
    x = np.round(rng.normal(0, 0.15, (300, 16)) * 8) / 8  # many ties
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    assert run(spark, rows) == expected(rows, 20, 20)


def test_block_scores():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (130, 7))
    index = bitsliced.Block(np.arange(130), np.arange(130), list(x))
    for q in (*rng.integers(-500, 500, (5, 7)), np.zeros(7, np.int64)):
        digits, plus = index.scores(q)
        bits = [np.unpackbits(d.view(np.uint8), bitorder="little")[:130].astype(np.int64) << s for s, d in enumerate(digits)]
        assert (sum(bits, np.zeros(130, np.int64)) + plus == x @ q).all()


def test_edges(spark):
    rng = random.Random(1)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(50)] + [(20, same), (None, same), (60, None), (80, [None, 1.0, 2.0]), (100, [math.nan, 0.0, 0.0])]
    rows += [(120, [math.inf, 0.0, 0.0]), (140, []), (160, [1.0]), (180, [-3.0e4, 2.5e4, 0.1, 7.0]), (181, [rng.random() for _ in range(5)]), (-20, [1.0, 1.0, 1.0])]
    got, want = run(spark, rows), expected(rows, 20, 20)
    # Two rows have id 20: each is the other's answer, and both are query 20.
    assert got == want
    assert run(spark, rows[:0]) == [] and run(spark, [(1, same)]) == [] and run(spark, [(0, same)]) == []
    assert run(spark, [(0, same), (1, same)]) == expected([(0, same), (1, same)], 20, 20)


def test_huge_components_are_held(spark):
    got = run(spark, [(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.0])])
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
