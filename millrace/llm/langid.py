"""Language identification in two levels.

A text is first given a language family, then one-versus-one linear support
vector machines tell that family's languages apart. Features are counts of
hashed byte trigrams over the whole lower-cased text, under a square root and
scaled to length one. Training is on a bounded sample of the labelled rows, as
many of each language, those of the least row hashes: ``PER_LANGUAGE``, or fewer if
there are so many languages that it would be more than ``SAMPLE`` in all. Every
language is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classlm import held_out
from .runtime import as_bytes, batch

DIMENSIONS = 4096
PER_LANGUAGE = 400
SAMPLE = 25_600
NO_LANGUAGE = "und"

# Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LATIN = re.compile(rb"[A-Za-z]")


def family(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return FAMILY_OF.get(code, f"own:{lang}")


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(text: bytes) -> np.ndarray:
    """Unit vector of the hashed byte trigrams; the text is taken piece by piece."""
    counts = np.zeros(DIMENSIONS, np.int64)
    lower = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    for lo in range(0, len(lower) - 2, 1 << 20):
        x = lower[lo : lo + (1 << 20) + 2].astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    v = np.sqrt(counts).astype(np.float32)
    n = float(np.linalg.norm(v))
    return v / n if n else v


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights, the last one the bias, of a linear machine with squared hinge loss.

    y is -1 or 1. Each class has half of the loss however few its rows are.
    Accelerated gradient descent with a step from the loss's curvature bound.
    """
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (1 + 2 * cost * float((share * (x * x).sum(axis=1)).sum()))
    w = last = np.zeros(x.shape[1])
    for i in range(steps):
        z = w + i / (i + 3) * (w - last)
        gap = np.maximum(0, 1 - y * (x @ z))
        last, w = w, z - rate * (z - 2 * cost * (x.T @ (share * y * gap)))
    return w.astype(np.float32)


class OneVersusOne:
    """A machine for each pair of labels; a label's score is the sum of its margins' sigmoids."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        at = np.array(labels)
        self.pairs = [(i, j) for i in range(len(self.names)) for j in range(i + 1, len(self.names))]
        rows = []
        for i, j in self.pairs:
            pick = (at == self.names[i]) | (at == self.names[j])
            rows.append(linear_svm(x[pick], np.where(at[pick] == self.names[i], 1.0, -1.0)))
        self.w = np.array(rows, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One row for each row of x; each sums to 1."""
        n = len(self.names)
        if n == 1:
            return np.ones((len(x), 1))
        margin = np.clip(x @ self.w[:, :-1].T + self.w[:, -1], -15, 15).astype(np.float64)
        p = 1 / (1 + np.exp(-3 * margin))
        out = np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += p[:, k]
            out[:, j] += 1 - p[:, k]
        # A label that wins all of its pairs has n - 1; the power spreads near ties of sums apart.
        out = (out / (n - 1)) ** 4
        return out / out.sum(axis=1, keepdims=True)


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str]):
        kin = [family(g) for g in langs]
        self.families = OneVersusOne(x, kin)
        self.within = {}
        for name in self.families.names:
            pick = [i for i, k in enumerate(kin) if k == name]
            self.within[name] = OneVersusOne(x[pick], [langs[i] for i in pick])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = self.families.scores(x)
        best = p.argmax(axis=1)
        names: list[str] = [""] * len(x)
        score = p[np.arange(len(x)), best]
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(best == k)
            if len(rows):
                q = self.within[name].scores(x[rows])
                top = q.argmax(axis=1)
                score[rows] *= q[np.arange(len(rows)), top]
                for r, t in zip(rows, top):
                    names[r] = self.within[name].names[t]
        return names, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("x", pa.binary())])
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            x = [features(t).tobytes() for t in as_bytes(part.column("text"))]
            yield batch(schema, part.column("lang"), part.column("h"), x)


def _sample(rows: DataFrame, per_language: int, most: int) -> DataFrame | None:
    """The rows (lang, text, h) of the least hashes h of each language, equal ones once."""
    # Copies have one hash and pass or fail together, so it is distinct hashes that are shared out.
    sizes = rows.groupBy("lang", "h").count().groupBy("lang").agg(F.count("*").alias("n")).toPandas().set_index("lang").n
    if not len(sizes):
        return None
    wanted = sizes.clip(upper=max(1, min(per_language, most // len(sizes))))
    # A hash threshold that lets about twice the wanted hashes of each language through, then the least of those.
    share = 2.0 * wanted / sizes

    def below(top: dict[str, int]) -> DataFrame:
        tops = rows.sparkSession.createDataFrame(list(top.items()), "lang_ string, top long")  # a row for each language
        return rows.join(F.broadcast(tops), F.col("lang") == F.col("lang_")).where("h <= top").select("lang", "text", "h")

    while True:
        near = below({lang: min(2**63 - 1, int((min(1.0, x) * 2 - 1) * 2**63)) for lang, x in share.items()})
        ids = near.select("lang", "h").distinct().toPandas().sort_values(["lang", "h"])
        found = ids.groupby("lang").size().reindex(sizes.index, fill_value=0)
        if (found >= wanted).all():
            break
        share = share.where(found >= wanted, 2 * share)
    ids = ids[ids.groupby("lang").cumcount() < ids.lang.map(wanted)]
    return below({lang: int(top) for lang, top in ids.groupby("lang").h.max().items()}).dropDuplicates(["lang", "h"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> Hierarchy | None:
    """Learns from rows (text, lang); None if no row has both a letter and a label.

    The sample depends on the rows only, not on their order or partitions. The
    machines number as the square of the families, and of each family's languages.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    picked = _sample(rows.select("lang", "text", F.xxhash64("lang", "text").alias("h")), per_language, most)
    if picked is None:
        return None
    found = picked.mapInArrow(_vectors, "lang string, h long, x binary").toPandas().sort_values(["lang", "h"])
    x = np.frombuffer(b"".join(found.x), np.float32).reshape(len(found), DIMENSIONS)
    return Hierarchy(x, list(found.lang))


def _predict(batches: Iterator[pa.RecordBatch], shared, text: str) -> Iterator[pa.RecordBatch]:
    model: Hierarchy | None = shared.value
    for b in batches:
        langs: list[str] = []
        scores: list[float] = []
        texts = as_bytes(b.column(text))
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            some = [i for i, t in enumerate(part) if model is not None and has_letter(t)]
            own, sure = [NO_LANGUAGE] * len(part), np.zeros(len(part))
            if some:
                names, p = model.predict(np.array([features(part[i]) for i in some]))
                for i, n in zip(some, names):
                    own[i] = n
                sure[some] = p
            langs += own
            scores += sure.tolist()
        more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score"])


def predict(spark: SparkSession, model: Hierarchy | None, df: DataFrame, text: str = "text") -> DataFrame:
    """Adds lang_pred and score. Null texts and texts without a letter are ``und`` with score 0."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*df.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    shared = spark.sparkContext.broadcast(model)  # a vector for each machine
    return df.mapInArrow(lambda x: _predict(x, shared, text), schema)


def identify(spark: SparkSession, docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Languages of documents (doc_id, text, lang), learned from those whose
    crc32(doc_id) mod ``modulus`` is not ``remainder``.

    Returns doc_id, held_out, lang_pred and score for each row, repeated rows
    included. Only the text decides a prediction. A null doc_id counts as an
    empty text's checksum and isn't held out. If nothing can be learned, all
    predictions are ``und``.
    """
    docs = docs.select("doc_id", "text", "lang", held_out("doc_id", modulus, remainder).alias("held_out"))
    model = train(docs.where(~F.col("held_out")).select("text", "lang"))
    out = predict(spark, model, docs.select("doc_id", "held_out", "text"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Drops documents without a language (null, or no letter), and sets lang where
    it is null to the prediction. All other columns stay as they are."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text, lang = (f"c{names.index(c)}" for c in ("text", "lang"))
    model = train(inner.select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    out = predict(spark, model, inner, text)
    if model is not None:
        out = out.where(F.col("lang_pred") != NO_LANGUAGE)
    out = out.withColumn(lang, F.coalesce(F.col(lang), F.col("lang_pred")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
