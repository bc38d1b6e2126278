"""Personal data in texts, plain and disguised, with offsets into the source.

Plain finds are those of four patterns on the text as it is. For disguised ones
a chain of transducers rewrites the text: look-alike characters become ASCII,
spelled digits become digits, and dressed-up "at" and "dot" become their signs.
Every transducer keeps for each character it writes the span it was read from,
so finds in the rewritten text are mapped back to spans of the source. They are
added only where something was rewritten and no plain find of the kind covers them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import batch

KINDS = ("email", "ip", "card", "phone")

# The plain patterns. A run of digits can't match from its middle
# if it doesn't from its start, which the look-behind of ip says.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    # Only an @ can end a local part, so the search goes from one @ to the next.
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return found


def _ips(text: str) -> list[Span]:
    return [
        ("ip", m.start(), m.end())
        for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    ]


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def _phones(text: str) -> list[Span]:
    out = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map("0123456789".__contains__, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def plain(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    return _emails(text) + _ips(text) + _cards(text) + _phones(text)


class Traced:
    """A text with the source span of each of its characters, and which were rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str | None]) -> None:
        """Replaces the matches of pattern; each character of a replacement spans its whole match."""
        parts, keep, at = [], [], 0
        for m in pattern.finditer(self.text):
            word = by(m)
            if word is None:
                continue
            keep.append((at, m.start(), m.start(), m.end(), len(word)))
            parts += (self.text[at : m.start()], word)
            at = m.end()
        if not keep:
            return
        parts.append(self.text[at:])
        start, end, new = [], [], []
        for lo, hi, a, b, n in keep:
            start += (self.start[lo:hi], np.full(n, self.start[a]))
            end += (self.end[lo:hi], np.full(n, self.end[b - 1]))
            new += (self.new[lo:hi], np.ones(n, bool))
        self.start = np.concatenate([*start, self.start[at:]])
        self.end = np.concatenate([*end, self.end[at:]])
        self.new = np.concatenate([*new, self.new[at:]])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.start[start]), int(self.end[end - 1])


# Cyrillic and Greek letters drawn like Latin ones.
_LIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαονρυχικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaovpuxikABEZHIKMNOPTYX"))
# The digits' names.
_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
#: Full-width forms, mathematical letters and digits, other scripts' digits, and the look-alikes above.
_HOMOGLYPH = re.compile("[" + "".join(_LIKE) + "！-～\U0001d400-\U0001d7ff①-⑳٠-٩۰-۹०-९․﹒﹫‐-―−]")
_NAME = "(?:" + "|".join(_NAMES) + ")"
_SPELLED = re.compile(rf"(?i)\b{_NAME}(?:[ ,.-]{{1,2}}(?:{_NAME}|[0-9])\b){{3,}}")
_ONE_NAME = re.compile(rf"(?i)\b{_NAME}\b[ ,-]{{0,2}}(?=(?:{_NAME}|[0-9])\b)|\b{_NAME}\b")
_AT = re.compile(r"(?i)\s{0,3}[(\[{<]\s{0,2}(?:at|@)\s{0,2}[)\]}>]\s{0,3}")
_DOT = re.compile(r"(?i)\s{0,3}[(\[{<]\s{0,2}(?:dot|\.)\s{0,2}[)\]}>]\s{0,3}")
_WORDS = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: (?:at|@) |@)[A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"
)
_HOST_WORDS = re.compile(r"(?i)@[A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++")
_DOT_WORD = re.compile(r"(?i) dot ")
_AT_WORD = re.compile(r"(?i) (?:at|@) ")
_DOTTED = re.compile(r"(?i)\bdot\b|[(\[{<]\s{0,2}(?:at|@|dot|\.)\s{0,2}[)\]}>]")


def _ascii(m: re.Match) -> str | None:
    c = m.group()
    if c in _LIKE:
        return _LIKE[c]
    if c in "‐‑‒–—―−":
        return "-"
    plain = unicodedata.normalize("NFKC", c)
    if not plain.isascii():
        plain = "".join(str(unicodedata.digit(x)) if x.isdigit() else x for x in plain)
    return plain if plain.isascii() else None


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Finds that only the rewritten text shows, beside the plain ones in ``known``."""
    glyphs = not text.isascii() and _HOMOGLYPH.search(text)
    dots = _DOTTED.search(text)
    names = _SPELLED.search(text)
    if not (glyphs or dots or names):
        return []
    t = Traced(text)
    if glyphs:
        t.rewrite(_HOMOGLYPH, _ascii)
    t.rewrite(_AT, lambda _: "@")
    t.rewrite(_DOT, lambda _: ".")
    # Bare words count only in the whole form "name at host dot name".
    whole = [m.span() for m in _WORDS.finditer(t.text)]
    if whole:
        inside = np.zeros(len(t.text) + 1, bool)
        for a, b in whole:
            inside[a:b] = True
        t.rewrite(_AT_WORD, lambda m: "@" if inside[m.start()] and inside[m.end() - 1] else None)
        whole = [m.span() for m in _HOST_WORDS.finditer(t.text)]
        inside = np.zeros(len(t.text) + 1, bool)
        for a, b in whole:
            inside[a:b] = True
        t.rewrite(_DOT_WORD, lambda m: "." if inside[m.start()] and inside[m.end() - 1] else None)
    spelled = [m.span() for m in _SPELLED.finditer(t.text)]
    if spelled:
        inside = np.zeros(len(t.text) + 1, bool)
        for a, b in spelled:
            inside[a:b] = True
        t.rewrite(
            _ONE_NAME,
            lambda m: _NAMES[m.group().strip(" ,-").lower()] if inside[m.start()] and inside[m.end() - 1] else None,
        )
    out = []
    for kind, a, b in plain(t.text):
        if t.new[a:b].any():
            start, end = t.source(a, b)
            if not any(k == kind and s <= start and end <= e for k, s, e in known):
                out.append((kind, start, end))
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The plain finds, and all finds, both by kind and start."""
    base = plain(text)
    more = disguised(text, base)
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """Puts <KIND> in the place of each span; spans that overlap become one, named by the first."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(parts) + text[at:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])
    for b in batches:
        rows = []
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            base, every = find(text or "")
            kinds = [k for k, _, _ in base]
            rows.append((i, *map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        if rows:
            yield batch(schema, *zip(*rows))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Personal data of documents (doc_id, text): doc_id, plain finds by kind (n_email,
    n_ip, n_card, n_phone), base_sha256 of the plain spans, all spans, and n_added,
    how many of these the plain patterns don't show.

    Null and empty texts have none. Every row gives a row, also if rows repeat.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        _report, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )


def masked(spark: SparkSession, docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """Documents with <KIND> in place of every find; ``length``, if there is such a
    column, becomes the new number of characters. Null texts stay null."""
    schema = StructType([*docs.schema.fields])
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if x is None else mask(x, find(x)[1]) for x in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = inner.mapInArrow(run, inner.schema).toDF(*schema.names)
    if length in schema.names:
        kind = schema[length].dataType
        out = out.withColumn(length, F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col(length)))
    return out
