import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid


def test_held_out_accuracy(spark, table):
    docs = table("documents", "sf0.01")
    got = langid.identify(spark, docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_the_label_is_no_input(spark, table):
    docs = table("documents").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1")
    train = table("documents").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    a = langid.identify(spark, train.unionByName(docs)).where("held_out").orderBy("doc_id").collect()
    changed = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'other' AS source", "n_chars")
    b = langid.identify(spark, train.unionByName(changed)).where("held_out").orderBy("doc_id").collect()
    assert a == b


def test_separable_classes():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1, 0.3, (30, 5)), rng.normal(-1, 0.3, (90, 5))].astype(np.float32)
    w = langid.linear_svm(x, np.r_[np.ones(30), -np.ones(90)])
    assert ((x @ w[:-1] + w[-1] > 0) == np.r_[np.ones(30, bool), np.zeros(90, bool)]).all()
    machine = langid.OneVersusOne(x, ["a"] * 30 + ["b"] * 45 + ["c"] * 45)
    assert np.allclose(machine.scores(x).sum(axis=1), 1)


def test_families():
    assert langid.family("de") == langid.family("en-GB") != langid.family("fr")
    assert langid.family("xyz") == "own:xyz"


def test_pieces_of_long_texts_add_up():
    text = ("abc déf " * 200_000).encode()
    short = langid.features(("abc déf " * 200).encode())
    assert np.allclose(langid.features(text), short, atol=0.05)


def test_edges(spark, edge, none):
    got = langid.identify(spark, edge)
    assert got.count() == edge.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0) for i in (1, 2, 3, 7))
    assert by_id[9].lang_pred in ("en", "de", "fr") and by_id[4].score > 0
    assert langid.identify(spark, none).collect() == []
    unlabelled = edge.withColumn("lang", edge.lang.substr(9, 1)).where("lang IS NULL OR true").selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.identify(spark, unlabelled).collect()} == {"und"}


def test_keep_identified(spark, edge, none):
    kept = langid.keep_identified(spark, edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert sorted(i for i in ids if i is not None) == [4, 4, 5, 6, 8, 9] and ids.count(None) == 1
    assert all(r.lang is not None for r in rows)
    assert langid.keep_identified(spark, none).collect() == []


def test_copies_take_no_places_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "Hierarchy", lambda x, langs: seen.append((len(x), langs)))
    rows = [("one page of many copies", "aa")] * 2000 + [(f"other page {i}", "aa") for i in range(60)] + [(f"seite {i}", "de") for i in range(30)]
    langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), 50)
    assert seen == [(80, ["aa"] * 50 + ["de"] * 30)]


def test_predictions_by_hand(spark, table):
    """Sample, features, families and votes again, with plain loops around the trained weights."""
    docs = table("documents")
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("lang", "text").alias("h")).collect()

    def vector(text):
        lower = b" " + (text or "").encode().lower() + b" "
        n = Counter((int.from_bytes(lower[i : i + 3], "big") * 2654435761) % 2**32 >> 20 for i in range(len(lower) - 2))
        length = math.sqrt(sum(n.values()))
        return np.array([math.sqrt(n[d]) / length if length else 0 for d in range(langid.DIMENSIONS)], np.float32)

    letters = lambda t: any(map(str.isalpha, t or ""))
    train = {(r.lang, r.h): r.text for r in rows if r.lang and letters(r.text) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    picked = []
    for lang in sorted({g for g, _ in train}):
        picked += sorted(k for k in train if k[0] == lang)[: langid.PER_LANGUAGE]
    model = langid.Hierarchy(np.array([vector(train[k]) for k in picked]), [g for g, _ in picked])

    def votes(machine, x):
        names, total = machine.names, Counter()
        if len(names) == 1:
            return {names[0]: 1.0}
        for (i, j), w in zip(machine.pairs, machine.w):
            p = 1 / (1 + math.exp(-3 * max(-15, min(15, float(x @ w[:-1] + w[-1])))))
            total[names[i]] += p
            total[names[j]] += 1 - p
        power = {n: (total[n] / (len(names) - 1)) ** 4 for n in names}
        return {n: v / sum(power.values()) for n, v in power.items()}

    got = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    for r in rows:
        if not letters(r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        x = vector(r.text)
        kin = votes(model.families, x)
        best = max(kin, key=kin.get)
        within = votes(model.within[best], x)
        top = max(within, key=within.get)
        assert got[r.doc_id].lang_pred == top and got[r.doc_id].score == pytest.approx(kin[best] * within[top], abs=2e-3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert re.match("[a-z]{2}$", top)


def test_every_language_is_learned(spark):
    words = {f"q{i:02}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}{chr(97 + i % 26)}" for c in "aeiouy"] for i in range(66)}
    rows = [(" ".join(w[k:] + w[:k]), lang) for lang, w in words.items() for k in range(3)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.families.names == sorted(f"own:{g}" for g in words)
    names, _ = model.predict(np.array([langid.features(t.encode()) for t, _ in rows]))
    assert np.mean([a == b for a, (_, b) in zip(names, rows)]) > 0.95
    assert langid._sample(spark.createDataFrame(rows, "text string, lang string").withColumn("h", F.xxhash64("text")), 400, 132).count() == 132
