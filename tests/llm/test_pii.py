import hashlib
import random
import re

import pytest

from millrace.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_plain_is_the_patterns(table):
    rng = random.Random(1)
    pieces = ["a", ".", "b", "@", "-", "%", "+", "1", "2", " ", "9", "(", "0.", ")", "255.", "4111 1111 1111 1111", "é", "@x.y", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert pii.plain(text) == slow(text)
    for r in table("documents").select("text").collect():
        assert pii.plain(r.text) == slow(r.text)


def test_long_runs_are_quick():
    for text in ("1" * 300_000, "a" * 300_000, "1.1" * 100_000, "a@" * 100_000, "+1" + "(" * 100_000, "@" * 300_000, "a.b" * 100_000 + "@"):
        pii.find(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("jane [at] mail (dot) example [dot] org.", "email", "jane [at] mail (dot) example [dot] org"),
        ("jane{at}mail.org", "email", "jane{at}mail.org"),
        ("ｊoe＠ехample.com", "email", "ｊoe＠ехample.com"),
        ("x jоhn@mail.example", "email", "jоhn@mail.example"),
        ("call +four nine one five one two three four five six seven", "phone", "+four nine one five one two three four five six seven"),
        ("host １９２.168.0.1", "ip", "１９２.168.0.1"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
    ],
)
def test_disguises_are_mapped_back(text, kind, part):
    base, every = pii.find(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in every
    assert set(base) <= set(every) and len(every) > len(base)
    assert pii.mask(text, every).count("<") == 1


@pytest.mark.parametrize(
    "text",
    ["we met at noon", "look at the dot", "it is at home dot", "one two three", "café naïve ß œuvre", "ten at example", "a dot b", "zero one", "№ ½ ²"],
)
def test_clean_texts_are_left_alone(text):
    assert pii.find(text) == ([], []) and pii.mask(text, []) == text


def test_mask_overlaps():
    assert pii.mask("abcdefgh", [("ip", 1, 3), ("card", 1, 5), ("phone", 4, 6)]) == "a<CARD>gh"


def test_report_and_edges(spark, edge, none):
    rows = edge.select("doc_id", "text").collect()
    got = pii.report(spark, edge).collect()
    key = lambda r: str((r[0], *r[1:]))
    want = []
    for i, text in rows:
        base, every = pii.find(text or "")
        kinds = [k for k, _, _ in base]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((i, *(kinds.count(k) for k in pii.KINDS), digest, pii.joined(every), len(every) - len(base)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert pii.report(spark, none).collect() == []
    masked = pii.masked(spark, edge)
    assert masked.columns == edge.columns and masked.count() == edge.count()
    assert pii.masked(spark, none).collect() == []


def test_masked(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd and c at d dot ef", 5), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.masked(spark, df).orderBy("doc_id").collect()] == [(1, "mail <EMAIL> and <EMAIL>", 24), (2, None, None)]


def test_disguised_addresses_of_any_length():
    for address in ("j" * 300 + " at host dot com", "a at " + "h" * 100 + " dot " + "p" * 100, "a at b" + "".join(f" dot p{i}" for i in range(40))):
        text = f"write to {address}, now"
        assert pii.find(text)[1] == [("email", 9, 9 + len(address))]
    for text in ("a at b dot c " * 3000, "a at b dot " * 3000, "x dot " * 20_000, "b" * 100_000 + " at", "a at " * 20_000):
        pii.find(text)
