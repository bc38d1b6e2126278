import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import substring, suffixes


def covered(d, length, hit):
    gone = np.zeros(len(d), bool)
    for i in range(len(d) - length + 1):
        if hit(d[i : i + length]):
            gone[i : i + length] = True
    return gone


def expected(texts, length, passage):
    data = [(t or "").encode() for t in texts]
    windows = lambda d, n: (hash(d[i : i + n]) for i in range(len(d) - n + 1))
    seen = Counter(w for d in data for w in windows(d, length))
    rows = Counter(w for d in data for w in set(windows(d, passage)))
    out = []
    for d in data:
        gone = covered(d, length, lambda w: seen[hash(w)] > 1)
        shared = int(covered(d, passage, lambda w: rows[hash(w)] > 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), shared))
    return out


def rows_of(got):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_shared) for r in got]


def strings(parts):
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    first = np.cumsum([0, *(len(p) for p in parts[:-1])])
    return np.frombuffer(b"".join(parts), np.uint8), first, ends


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    for _ in range(150):
        letters = rng.choice([b"ab", b"a", b"a\0b", b"abcdef"])
        text, first, ends = strings([bytes(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 8))])
        suffix = [text[i : ends[i]].tobytes() for i in range(len(text))]
        order = suffixes.suffix_array(text, ends)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffix[i], i))
        shared = suffixes.common_prefixes(text, first, ends, order, 30)
        for j in range(1, len(order)):
            a, b = suffix[order[j - 1]], suffix[order[j]]
            k = next((k for k in range(min(len(a), len(b), 30)) if a[k] != b[k]), min(len(a), len(b), 30))
            assert shared[j] == k
        pattern = bytes(rng.choices(letters, k=2))
        lo, hi = suffixes.locate(text, ends, order, pattern)
        assert hi - lo == sum(s.startswith(pattern) for s in suffix)


def test_prefix_classes_are_those_of_equal_prefixes():
    rng = random.Random(3)
    for k in range(150):
        parts = [bytes(rng.choices(b"ab\0" if k % 2 else b"abcdefgh", k=rng.randint(1, 40))) * rng.randint(1, 3) for _ in range(rng.randint(1, 10))]
        parts += [rng.choice(parts)[rng.randrange(3) :] + b"q" for _ in range(5)]
        text, _, ends = strings(parts)
        depths = sorted(rng.sample(range(1, 60), 2))
        wanted = [np.array([rng.random() < 0.6 for _ in text]) for _ in depths]
        for depth, mask, found in zip(depths, wanted, suffixes.prefix_classes(text, ends, depths, wanted)):
            numbers = {}
            for i in np.flatnonzero(mask & (ends - np.arange(len(text)) >= depth)):
                numbers.setdefault(text[i : i + depth].tobytes(), set()).add(int(found[i]))
            in_order = [n for prefix in sorted(numbers) for n in numbers[prefix]]
            assert in_order == sorted(set(in_order)) and len(in_order) == len(numbers)


def test_every_window_has_its_anchor(monkeypatch):
    monkeypatch.setattr(substring, "_PIECE", 1 << 12)
    substring._powers.cache_clear()
    rng = random.Random(5)
    for n in (0, 39, 40, 41, 500, 9000):
        text = bytes(rng.choices(b"abc ", k=n))
        h, first, last, at = substring.anchors(text, 40, 8)
        assert all(a <= p <= a + 32 and z <= p for a, z, p in zip(first, last, at))
        windows = [i for a, z in zip(first, last) for i in range(a, z + 1)]
        assert windows == list(range(max(0, n - 39)))
    # The same window has the same anchor wherever it is.
    window = bytes(rng.choices(b"abcdefgh", k=40))
    found = set()
    for before, after in ((0, 0), (7, 3), (4090, 50)):
        text = bytes(rng.choices(b"xyz", k=before)) + window + bytes(rng.choices(b"xyz", k=after))
        h, first, last, _ = substring.anchors(text, 40, 8)
        found |= {int(a) for a, f, z in zip(h, first, last) if f <= before <= z}
    assert len(found) == 1
    substring._powers.cache_clear()


@pytest.mark.parametrize("share", [1000, 2])
@pytest.mark.parametrize("passage", [24, 40])
def test_planted_repeats(spark, share, passage):
    rng = random.Random(6)

    def text(n):
        return "".join(rng.choices("abcdefghijklmnop é", k=n))

    shared = [text(n) for n in (30, 60, 130, 39, 41)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randint(0, 120))]
        for s in rng.choices(shared, k=rng.randint(0, 3)):
            parts += [s, text(rng.randint(0, 20))]
        texts.append("".join(parts))
    texts += [texts[0], texts[0], "ab" * 100, "ab" * 90, "x" * 300, text(200) * 2, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substring.remove_repeats(spark, df, 40, 8, share, passage).orderBy("doc_id").collect()
    assert rows_of(got) == expected(texts, 40, passage)
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)


def test_table(spark, table):
    docs = table("documents")
    texts = docs.orderBy("doc_id").select("text").toPandas().text
    got = substring.remove_repeats(spark, docs).orderBy("doc_id").collect()
    assert rows_of(got) == expected(texts, 400, substring.PASSAGE)


def test_an_anchor_of_over_a_thousand_regions(spark):
    """At production settings: common passages whose surroundings differ, so that all regions do."""
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choices("abcdefghijklmnop é", k=n))

    common = [text(380), text(700), text(270), text(128)]
    texts = [text(rng.randint(0, 60)) + common[min(3, i % 5)] + text(rng.randint(0, 60)) for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(spark, df).orderBy("doc_id").collect()
    assert rows_of(got) == expected(texts, 400, substring.PASSAGE)
    assert sum(r.n_removed > 0 for r in got) > 800 and sum(r.n_shared > 0 for r in got) > 2000


def test_edges(spark, edge, none):
    texts = [r.text for r in edge.select("text").collect()]
    got = substring.remove_repeats(spark, edge, length=40, gram=8, passage=24).collect()
    assert sorted(rows_of(got)) == sorted(expected(texts, 40, 24))
    assert substring.remove_repeats(spark, none).collect() == []
    with pytest.raises(ValueError):
        substring.remove_repeats(spark, edge, length=100)
