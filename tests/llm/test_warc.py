import gzip
import random
from collections import defaultdict

import pytest

from millrace.llm import warc
from millrace.llm.runtime import Scratch

PAGES = "page_id long, url string, html string, digest string, `a.b` int, n int"


def expected(pages):
    same = defaultdict(list)
    for i, _, html in pages:
        same[html or ""].append(i)
    out = []
    for html, ids in same.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            data = html.encode()
            response = n == 0
            out.append((i, len(data), warc.digest(data), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def table(spark, pages):
    return spark.createDataFrame([(*p, "d", 1, 2) for p in pages], PAGES).repartition(3)


@pytest.mark.parametrize("split", [50, 1000, 1 << 23])
def test_roundtrip(spark, split):
    rng = random.Random(split)
    html = ["", "<p>é</p>", "x" * 5000, "".join(chr(rng.randrange(32, 5000)) for _ in range(3000))]
    pages = [(i, f"http://h/{i}\n", rng.choice(html)) for i in range(60)] + [(100 + i, None, f"<i>{i}</i>" * i) for i in range(30)]
    got = warc.roundtrip(spark, table(spark, pages), split).collect()
    assert sorted(map(tuple, got), key=str) == expected(pages)


def test_edges(spark):
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<b>"), (None, None, "<b>"), (5, "u", "<b>"), (5, "u", "<b>"), (5, "v", "<b>"), (4, "u", "<b>"),
        (None, None, None), (None, None, "only null"), (None, "x", "only null"), (7, "u", "once"),
    ]
    got = warc.roundtrip(spark, table(spark, pages)).collect()
    assert sorted(map(tuple, got), key=str) == expected(pages)
    assert warc.roundtrip(spark, table(spark, pages).limit(0)).collect() == []


def test_false_magic_and_records_across_ranges(tmp_path):
    rng = random.Random(9)
    data, starts = b"", []
    for i in range(40):
        payload = rng.randbytes(rng.randint(0, 400)) + warc.MAGIC * rng.randint(0, 30) + rng.randbytes(50)
        member = warc.record(i, f"u{i}", payload, "00" * 20, len(payload), None, False)
        if i % 7 == 3:  # stored, so that the payload's magic bytes stay as they are
            member = gzip.compress(gzip.decompress(member), 0)
        starts.append(len(data))
        data += member
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    whole = [p for p, _, _ in warc.records(f"file://{path}", len(data), 0, len(data))]
    assert whole == starts
    for size in (37, 200, 1000, 5000):
        ranges = [(lo, min(lo + size, len(data))) for lo in range(0, len(data), size)]
        found = [p for lo, hi in ranges for p, _, _ in warc.records(f"file://{path}", len(data), lo, hi)]
        assert found == starts
    assert list(warc.records(f"file://{path}", 20, 0, 20)) == []


def test_fields(spark):
    scratch = Scratch(spark, "t")
    rows = warc.read(warc.write(scratch, table(spark, [(1, "http://a", "x"), (2, "http://b", "x")]))).collect()
    by_type = {r.fields["warc-type"]: r for r in rows}
    assert bytes(by_type["response"].payload) == b"x" and bytes(by_type["revisit"].payload) == b""
    assert by_type["revisit"].fields["warc-refers-to"] == by_type["response"].fields["warc-record-id"]
    assert by_type["response"].fields["warc-target-uri"] == "http://b"
