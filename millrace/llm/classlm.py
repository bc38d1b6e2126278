"""Brown class-based bigram language model: training and document scores.

Exchange clustering puts every word of the dictionary into a class; the end of a
text and all words beyond the dictionary are two more classes of their own. A word
costs P(class | class before) * P(word | class). A word beyond the dictionary has
(c + 1) / (N + V + 1) of its class: N tokens and V distinct words of the class
were seen in training, c times this one; one share is kept for all others.

All counts are over all training documents. The bigrams stay on the cluster, dealt
by word into buckets that hold the words' successors and predecessors. The most
frequent words are clustered first, one at a time, in the driver; then rounds over
all words follow, in which each bucket finds the classes in which its words raise
the likelihood most. What reaches the driver is bounded by parameters: count bins,
``DICTIONARY`` words of up to ``LONGEST_WORD`` bytes, the bigrams of ``FREQUENT``
words and those of the classes. Counts of other words never leave the cluster: a
join brings them to the documents that hold such words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, as_bytes, batch

DICTIONARY = 131_072
LONGEST_WORD = 64
#: Words seen less often tell too little of their class to be in the dictionary.
LEAST = 2
FREQUENT = 512
CLASSES = 64
SWEEPS = 20
#: Rounds over all words end where one gains less than this many nats a token, or after so many.
SETTLED = 1e-4
ROUNDS = 16
#: The end of a text, counted as a token; no word is empty.
END = b""
FLUSH = 400_000
#: Bigrams that a task sums up before it deals them out, and tokens for each bucket.
PAIRS = 4_000_000
BUCKET_TOKENS = 2_000_000
_SHIFT = 20


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)) == remainder


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return batch(schema, pa.array(list(seen), pa.binary()), np.fromiter(seen.values(), np.int64, len(seen)))

    for b in batches:
        for text in as_bytes(b.column(0)):
            seen.update(text.lower().split())
            seen[END] += 1
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of a one-column table; the end of each text counts as a word."""
    rows = texts.mapInArrow(_count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The dictionary and its counts; word 0 is END, and a number more stands for all other words.

    The most frequent words are in, of those that are equally frequent (to a 16th of
    a doubling) at the dictionary's end the ones of the least hashes; about ``size``.
    """

    def __init__(self, counts: DataFrame, size: int = DICTIONARY, least: int = LEAST):
        level = F.floor(F.log2("n") * 16).cast("int")
        fits = (F.octet_length("word") <= LONGEST_WORD) & (F.col("word") != END) & (F.col("n") >= least)
        bins = counts.groupBy(level.alias("level")).agg(
            F.count("*").alias("v"), F.sum("n").alias("n"), F.count(F.when(fits, 1)).alias("fit")
        )
        bins = bins.toPandas().sort_values("level", ascending=False)
        self.tokens, self.distinct = int(bins.n.sum()), int(bins.v.sum())
        over = bins[bins.fit.cumsum() > size]
        last, share = -1, 0
        if len(over):
            last = int(over.level.iloc[0])
            taken = int(bins.fit[bins.level > last].sum())
            share = ((size - taken) << _SHIFT) // int(over.fit.iloc[0])
        draw = F.pmod(F.xxhash64("word"), F.lit(1 << _SHIFT))
        self._inside = (F.col("word") == END) | (fits & ((level > last) | ((level == last) & (draw < share))))
        words = counts.where(self._inside).toPandas()
        words["word"] = [bytes(w) for w in words.word]
        words = words.sort_values(["n", "word"], ascending=[False, True])
        if END not in set(words.word):
            words = pd.concat([pd.DataFrame({"word": [END], "n": [0]}), words])
        words = pd.concat([words[words.word == END], words[words.word != END]])
        self.words: list[bytes] = list(words.word)
        self.n = words.n.to_numpy(np.int64)
        self.other = len(self.words)
        # Tokens and distinct words beyond the dictionary.
        self.other_n = self.tokens - int(self.n.sum())
        self.other_v = self.distinct - int((self.n > 0).sum())

    def tail(self, counts: DataFrame) -> DataFrame:
        """The counts of the words that are not in the dictionary."""
        return counts.where(~self._inside)


_ENCODED = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("log_counts", pa.float64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
    ]
)


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each document's word numbers, what the dictionary tells of it, and its other words with their counts."""
    words, n = shared.value
    place, other = dict(zip(words, range(len(words)))), len(words)
    log_n, known = np.r_[np.log10(n + 1.0), 0.0], np.r_[n > 0, False].astype(np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            rows = []
            for text in as_bytes(part.column("text")):
                tokens = text.lower().split()
                tokens.append(END)
                ids = np.array([place.get(w, other) for w in tokens], np.int32)
                rest = Counter(tokens[i] for i in np.flatnonzero(ids == other).tolist())
                rows.append((len(tokens), int(known[ids].sum()), float(log_n[ids].sum()), ids.tobytes(), list(rest), list(rest.values())))
            yield batch(_ENCODED, part.column("doc_id"), part.column("held_out"), *zip(*rows))


def _packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs with their counts."""
    return zstandard.compress(np.diff(pairs, prepend=0).tobytes() + n.astype(np.int64).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(blob), np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, n
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    heads = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[heads], np.add.reduceat(n[order], heads)


_DEALT = pa.schema([("bucket", pa.int32()), ("side", pa.int32()), ("blob", pa.binary())])


def _bigrams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each bucket's words with their successors (side 0) and predecessors (side 1)."""
    mask = (1 << _SHIFT) - 1

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(parts), return_counts=True)
        out = []
        for side in (0, 1):
            if side:
                pairs = (pairs & mask) << _SHIFT | pairs >> _SHIFT
                order = np.argsort(pairs)
                pairs, n = pairs[order], n[order]
            to = (pairs >> _SHIFT) % buckets
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            out += [(k, side, _packed(pairs[order[a:z]], n[order[a:z]])) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
        return batch(_DEALT, *zip(*out))

    held, size = [], 0
    for b in batches:
        for x in b.column(0).to_pylist():
            ids = np.frombuffer(x, np.int32)
            for lo in range(0, len(ids), PAIRS):
                now = ids[lo : lo + PAIRS].astype(np.int64)
                # A text's first word follows the end of another.
                before = np.r_[ids[lo - 1] if lo else 0, now[:-1]]
                held.append(before << _SHIFT | now)
                size += len(now)
                if size >= PAIRS:
                    yield dealt(held)
                    held, size = [], 0
    if held:
        yield dealt(held)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, from rows sorted by it."""
    schema = pa.schema([("bucket", pa.int32()), ("after", pa.binary()), ("before", pa.binary())])

    def whole(bucket: int, sides: tuple[list, list]) -> pa.RecordBatch:
        blobs = [_packed(*_summed(*(np.concatenate(x) for x in zip(*map(_unpacked, side))))) for side in sides]
        return batch(schema, [bucket], *([x] for x in blobs))

    now, sides = None, ([_packed(*[np.zeros(0, np.int64)] * 2)], [_packed(*[np.zeros(0, np.int64)] * 2)])
    for b in batches:
        for bucket, side, blob in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now:
                if now is not None:
                    yield whole(now, sides)
                now, sides = bucket, tuple([x[0]] for x in sides)
            sides[side].append(blob)
    if now is not None:
        yield whole(now, sides)


def _cells(batches: Iterator[pa.RecordBatch], shared, kinds: int) -> Iterator[pa.RecordBatch]:
    """Bigrams of the words' kinds, of words that have one."""
    of = shared.value
    total = np.zeros(kinds * kinds, np.int64)
    for b in batches:
        for blob in b.column("after").to_pylist():
            pairs, n = _unpacked(blob)
            x, y = of[pairs >> _SHIFT], of[pairs & ((1 << _SHIFT) - 1)]
            some = (x >= 0) & (y >= 0)
            total += np.bincount(x[some] * kinds + y[some], weights=n[some], minlength=kinds * kinds).astype(np.int64)
    at = np.flatnonzero(total)
    if len(at):
        yield batch(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), at, total[at])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(pairs: np.ndarray, n: np.ndarray, words: np.ndarray, of: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """What each of the words, which are sorted, adds to the likelihood in each class by its neighbours
    on one side; in its own class, what is lost without it. ``table`` has the words' classes as rows."""
    kinds = len(table)
    at = np.searchsorted(words, pairs >> _SHIFT)
    at[at == len(words)] = 0
    to = of[pairs & ((1 << _SHIFT) - 1)]
    some = (words[at] == pairs >> _SHIFT) & (to >= 0)
    seen = np.bincount(at[some] * kinds + to[some], weights=n[some], minlength=len(words) * kinds)
    cell = np.flatnonzero(seen)
    out = np.zeros((len(words), classes))
    sums = np.zeros(len(words))
    own = of[words]
    for lo in range(0, len(cell), 1 << 15):
        part = cell[lo : lo + (1 << 15)]
        word, j, x = part // kinds, part % kinds, seen[part]
        here = table[:classes, j].T
        gain = _f(here + x[:, None]) - _f(here)
        mine = np.flatnonzero(own[word] >= 0)
        held = table[own[word[mine]], j[mine]]
        gain[mine, own[word[mine]]] = _f(held) - _f(np.maximum(held - x[mine], 0))
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[heads]] += np.add.reduceat(gain, heads, axis=0)
        sums += np.bincount(word, weights=x, minlength=len(words))
    total = table[:classes].sum(axis=1)
    loss = _f(total + sums[:, None]) - _f(total)
    mine = np.flatnonzero(own >= 0)
    loss[mine, own[mine]] = _f(total[own[mine]]) - _f(np.maximum(total[own[mine]] - sums[mine], 0))
    return out - loss


def _moves(batches: Iterator[pa.RecordBatch], shared, classes: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The words of this part that do better in another class, and that class."""
    of, table = shared.value
    schema = pa.schema([("word", pa.int64()), ("to", pa.int64())])
    for b in batches:
        for after, before in zip(b.column("after").to_pylist(), b.column("before").to_pylist()):
            (a, n), (p, m) = _unpacked(after), _unpacked(before)
            words = np.unique(np.r_[a >> _SHIFT, p >> _SHIFT])
            turn = (words * 0x9E3779B1 >> 12) % parts == part
            words = words[(of[words] < 0) | (of[words] < classes) & turn]
            if not len(words):
                continue
            gain = _gains(a, n, words, of, table, classes) + _gains(p, m, words, of, table.T, classes)
            best, own = gain.argmax(axis=1), of[words]
            row = np.arange(len(words))
            moved = (own < 0) | (gain[row, best] > gain[row, np.maximum(own, 0)] + 1e-6)
            yield batch(schema, words[moved], best[moved])


class Bigrams:
    """Counted pairs of neighbouring words, in buckets on the cluster."""

    def __init__(self, scratch: Scratch, encoded: DataFrame, v: Vocabulary):
        self.spark = scratch.spark
        buckets = min(v.other + 1, max(64, v.tokens // BUCKET_TOKENS))
        rows = encoded.select("ids").mapInArrow(lambda x: _bigrams(x, buckets), "bucket int, side int, blob binary")
        rows = rows.repartition("bucket").sortWithinPartitions("bucket")
        self.rows = scratch.save(rows.mapInArrow(_gathered, "bucket int, after binary, before binary"), "bigrams")

    def table(self, of: np.ndarray, kinds: int) -> np.ndarray:
        """Bigrams of kinds; ``of`` has each word's kind, -1 for none."""
        shared = self.spark.sparkContext.broadcast(of.astype(np.int64))
        rows = self.rows.select("after").mapInArrow(lambda x: _cells(x, shared, kinds), "cell long, n long")
        found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # kinds squared rows at most
        out = np.zeros(kinds * kinds)
        out[found.cell.to_numpy(np.int64)] = found.n
        return out.reshape(kinds, kinds)

    def moves(self, of: np.ndarray, table: np.ndarray, classes: int, part: int, parts: int) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast((of.astype(np.int64), table))
        rows = self.rows.mapInArrow(lambda x: _moves(x, shared, classes, part, parts), "word long, to long")
        found = rows.toPandas()  # as many rows as the dictionary has words, at most
        out = of.copy()
        out[found.word.to_numpy(np.int64)] = found.to
        return out


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, without what doesn't depend on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words by exchange: each word in turn moves to the class for which
    the class bigrams' likelihood is greatest, until a sweep moves none, ``sweeps`` times at most.

    ``pairs`` is the square matrix of the words' bigrams. Ties go to the least class.
    """
    size = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    table = member.T @ pairs @ member

    for _ in range(sweeps):
        moved = 0
        for t in order:
            if not weight[t]:
                continue
            own, a = pairs[t, t], of[t]
            to = pairs[t] @ member
            frm = pairs[:, t] @ member
            to[a] -= own
            frm[a] -= own
            # The table without t, then the gain of putting t into each class.
            table[a] -= to
            table[:, a] -= frm
            table[a, a] -= own
            row, col = _f(table + to[None, :]) - _f(table), _f(table + frm[:, None]) - _f(table)
            d = np.arange(classes)
            both = _f(table[d, d] + to + frm + own) - _f(table[d, d])
            gain = row.sum(axis=1) - row[d, d] + col.sum(axis=0) - col[d, d] + both
            left, right = table.sum(axis=1), table.sum(axis=0)
            # A class that t enters gains all of t's bigrams; what t follows or precedes gains its share anyway.
            after_l, after_r = left + frm, right + to
            sums_l = _f(after_l + to.sum() + own) - _f(after_l)
            sums_r = _f(after_r + frm.sum() + own) - _f(after_r)
            best = int(np.argmax(gain - sums_l - sums_r))
            table[best] += to
            table[:, best] += frm
            table[best, best] += own
            if best != a:
                member[t, a], member[t, best], of[t] = 0, 1, best
                moved += 1
        if not moved:
            break
    return of


def cluster(bigrams: Bigrams, v: Vocabulary, classes: int = CLASSES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, and the class bigrams. END and the words beyond the dictionary are classes of their own.

    Words of a round move at once, half of them in each; a round that doesn't raise the likelihood
    is dropped, and the next ones move smaller parts.
    """
    kinds = classes + 2
    of = np.full(v.other + 1, -1, np.int64)
    top = min(frequent, v.other - 1)
    if top:
        seat = np.full(v.other + 1, -1, np.int64)
        seat[1 : top + 1] = np.arange(top)
        of[1 : top + 1] = exchange(bigrams.table(seat, top), min(classes, top))
    of[0], of[v.other] = classes, classes + 1
    table = bigrams.table(of, kinds)
    if (of < 0).any():
        of = bigrams.moves(of, table, classes, 1, 1)  # no part: only words without a class
        of[of < 0] = 0
    table = bigrams.table(of, kinds)
    reached, parts, still, turn = likelihood(table), 2, 0, 0
    for _ in range(rounds):
        new = bigrams.moves(of, table, classes, turn % parts, parts)
        turn += 1
        if (new == of).all():
            still += 1
        else:
            new_table = bigrams.table(new, kinds)
            got = likelihood(new_table)
            if got <= reached:
                parts, turn = 2 * parts, 0
                still += 1
            else:
                still = 0 if got - reached > SETTLED * v.tokens else still + 1
                of, table, reached = new, new_table, got
        if still >= parts:
            break
    return of, table


class ClassModel:
    """Log10 probabilities: of a class after a class, and of a word in its class."""

    def __init__(self, v: Vocabulary, of: np.ndarray, table: np.ndarray):
        self.of, kinds = of, len(table)
        n = np.r_[v.n, v.other_n].astype(np.float64)
        total, size = np.bincount(of, weights=n, minlength=kinds), np.bincount(of, minlength=kinds)
        single = (total + 1) / (n.sum() + kinds)
        follow = np.maximum((table > 0).sum(axis=1, keepdims=True), 1)  # Witten and Bell's mass for what has not followed
        seen = table.sum(axis=1, keepdims=True)
        self.step = np.log10((table + follow * single) / (seen + follow))
        self.emit = np.log10((n + 0.5) / (total + 0.5 * size)[of])
        self.emit[v.other] -= np.log10(v.other_n + v.other_v + 1.0)

    def score(self, ids: np.ndarray) -> float:
        c = self.of[ids]
        return float(self.step[np.r_[self.of[0], c[:-1]], c].sum() + self.emit[ids].sum())


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    schema = pa.schema([("row", pa.int64()), ("part", pa.float64())])
    for b in batches:
        yield batch(schema, b.column("row"), [model.score(np.frombuffer(x, np.int32)) for x in b.column("ids").to_pylist()])


def class_lm_scores(spark: SparkSession, docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Scores documents (doc_id, text) by a class model and by a unigram base.

    Learns from the documents whose crc32(doc_id) mod ``modulus`` is not
    ``remainder``. Returns for each row doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score and perplexity. Null texts are empty: one
    token, the end. A null doc_id is a training document (crc32 of an empty
    text). Repeated rows are counted and returned each. Without training
    documents nothing is known and all scores come from the smoothing.
    """
    scratch = Scratch(spark, "classlm")
    docs = docs.select("doc_id", "text", held_out("doc_id", modulus, remainder).alias("held_out"))
    counts = scratch.save(word_counts(docs.where(~F.col("held_out")).select("text")), "counts")
    v = Vocabulary(counts)
    shared = spark.sparkContext.broadcast((v.words, v.n))
    encoded = docs.mapInArrow(
        lambda x: _encode(x, shared),
        "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, ids binary, words array<binary>, times array<int>",
    )
    encoded = scratch.save(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = ClassModel(v, *cluster(Bigrams(scratch, encoded.where(~F.col("held_out")), v), v))
    scratch.drop("bigrams")
    held = spark.sparkContext.broadcast(model)
    local = encoded.select("row", "ids").mapInArrow(lambda x: _score(x, held), "row long, part double")

    tail = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    tail = tail.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = tail.join(v.tail(counts), "word").groupBy("row")
    tail = tail.agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"))

    thin = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts")
    out = thin.join(local, "row").join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    score = F.col("part") + tail_log
    base = F.col("log_counts") + tail_log - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
    return scratch.finish(out)
