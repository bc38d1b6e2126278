import math

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.runtime import Scratch


def expected_targets(sizes, repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(repeats * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return share | {s: float(repeats * sizes[s]) for s in full}
        full |= set(over)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5, "é": 7, "Z": 900}, {"x": 50}, {"x": 0, "y": 10}, {"x": 0, None: 0},
        {None: 500, "a": 3, "b": 2, "c": 1, "": 4}, {f"s{i}": (i * 37) % 101 for i in range(50)},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = {r.source: r.target for r in mixing.targets(Scratch(spark, "t"), df).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def table(spark, sizes, n):
    rows = [(i, "w " * (1 + i % 9), s) for s in sizes for i in range(n * sizes[s])]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_taken_comes_near_the_targets(spark):
    df = table(spark, {"a": 1, "b": 7, "c": 2, None: 3}, 60)
    got = mixing.mix(spark, df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == df.count()
    assert (got["size"] == df.toPandas().set_index("doc_id").text[got.doc_id].str.split().str.len().to_numpy()).all()
    sums = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "sum"), said=("source_size", "first"))
    assert (sums.n == sums.said).all()
    assert (abs(sums.taken - sums.target) <= 9).all()
    # Whole epochs first: every document has at least as many copies as fit the target.
    copies = got.taken / got["size"]
    assert (copies >= got.target // got.source_size).all() and (copies <= 3).all() and (copies % 1 == 0).all()


def test_reruns_agree(spark):
    df = table(spark, {"a": 1, "b": 4, "c": 2}, 40)
    runs = [sorted(map(tuple, mixing.mix(spark, df.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_better_documents_are_likelier(spark):
    rows = [(i, ("good words only " if i % 2 else "1234 5678 ### ") + "x" * (i % 3), "a") for i in range(4000)]
    rows += [(10_000 + i, "y " * 5, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(spark, df).where("doc_id < 4000").toPandas()
    odd = got.doc_id % 2 == 1
    assert got.taken[odd].sum() > 1.5 * got.taken[~odd].sum() > 0


def test_one_bin_holds_the_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 0.001)
    df = table(spark, {"a": 1, "b": 7, "c": 2}, 30)
    got = mixing.mix(spark, df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 9).all()


def test_edges(spark, edge, none):
    got = mixing.mix(spark, edge).collect()
    assert len(got) == edge.count()
    assert all(r.taken == 0 for r in got if not r["size"]) and all(r.taken <= 3 * r["size"] for r in got)
    sizes = {}
    for r in edge.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    assert sorted({r.target for r in got}) == pytest.approx(sorted(set(expected_targets(sizes).values())))
    assert mixing.mix(spark, none).collect() == []
    assert mixing.mixed(spark, none).collect() == []


def test_mixed_repeats_rows(spark, edge):
    out = mixing.mixed(spark, edge)
    assert out.columns == edge.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(spark, edge).collect() if r.doc_id in (5, 6, 8, 9)}
    words = out.where("doc_id IN (5, 6, 8, 9)").withColumn("n", F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))
    assert {r.doc_id: r.n for r in words.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("bins", [512, 1, 100_000])
def test_draw_by_hand(spark, table, monkeypatch, bins):
    """Every document's copies again: each source's keys sorted as a whole, and the sizes summed up."""
    monkeypatch.setattr(mixing, "BINS", bins)
    docs = table("documents").select("doc_id", "text", "source", F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(mixing.SEED)).alias("h"))
    rows = docs.collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    goal, want = expected_targets(total), {}
    for source in total:
        epochs = int(goal[source] // total[source]) if total[source] else 0
        budget, run = goal[source] - epochs * total[source], 0
        key = lambda r: -math.log((((r.h % 2**64) >> 11) + 0.5) / 2**53) / mixing.quality((r.text or "").encode())
        for r in sorted((r for r in rows if r.source == source), key=key):
            run += size[r.doc_id]
            want[r.doc_id] = size[r.doc_id] * min(3, epochs + (run - size[r.doc_id] / 2 <= budget))
    assert {r.doc_id: r.taken for r in mixing.mix(spark, docs).collect()} == want
