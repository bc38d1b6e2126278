"""Exact removal of long strings that occur more than once in a corpus.

Strings of ``length`` bytes that start at two places are removed. Strings of
``passage`` bytes, which are shorter, are only reported, where another document
has them.

Each window of ``passage`` bytes has an anchor: the least of the hashes of the
short strings in it, the leftmost of equal ones. Equal windows have equal
anchors at equal places, so windows need to meet only under their anchor, and
those of ``length`` bytes under the anchor of their beginning. An anchor's windows
are neighbours; with the ``length`` bytes from the last one on they make up one
region of a text. Regions whose anchor occurs once hold no repeats and go no
further.

Regions are dealt to shards by anchor. A shard sorts the suffixes of its regions by
Larsson-Sadakane refinement as far as the windows reach: neighbours in this suffix
array that share so many bytes are the repeats. Regions that agree with
no other of their anchor in enough bytes on either side of it hold none, and are
left out. An anchor with many regions is dealt to several shards; each then publishes the windows it has found
under their digests, and the published lists are sorted, merged and looked up by
binary search, so that equal windows of different shards meet too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, as_bytes, batch, sorted_runs
from .suffixes import LONGEST, PLACE_BITS, prefix_classes

LENGTH = 400
#: Bytes of a reported passage; 50 words are mostly more.
PASSAGE = 256
GRAM = 100
SHARE = 1000  # regions of one anchor that a shard gets, about
SHARD_BYTES = 900_000
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(_PIECE - 1, x & (1 << 64) - 1, np.uint64)], dtype=np.uint64)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each place on; depends on these bytes alone."""
    up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * down[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * up[: n - width + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' hashes, the first and last window start of each, and their places; none for short texts."""
    span = length - gram + 1
    empty = np.zeros(0, np.int64)
    hashes, first, last, places = [empty], [empty], [empty], [empty]
    step = _PIECE - length + 1
    for lo in range(0, max(0, len(text) - length + 1), step):
        data = np.frombuffer(text, np.uint8)[lo : lo + _PIECE]
        h = gram_hashes(data, gram)
        m = len(h)
        # Smallest hash, then leftmost place: both in one number.
        key = np.full(-(-m // span) * span, np.uint64((1 << 64) - 1))
        key[:m] = (h & ~np.uint64(_PIECE - 1)) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[: m - span + 1], ahead[span - 1 : m]) & np.uint64(_PIECE - 1)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        hashes.append(h[place[cut]].view(np.int64))
        first.append(cut + lo)
        last.append(np.r_[cut[1:], len(place)] - 1 + lo)
        places.append(place[cut] + lo)
    return tuple(map(np.concatenate, (hashes, first, last, places)))


_ANCHORED = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("sha256", pa.string()),
     ("hash", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))]
)


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            rows = []
            for text in as_bytes(part.column("text")):
                rows.append((len(text), hashlib.sha256(text).hexdigest(), *anchors(text, length, gram)))
            yield batch(_ANCHORED, part.column("doc_id"), part.column("key"), *zip(*rows))


def _regions(batches: Iterator[pa.RecordBatch], length: int, share: int) -> Iterator[pa.RecordBatch]:
    """A row for each region: anchor, shard of the anchor, whether there are others, text, start, windows, the anchor's place in it, bytes."""
    schema = pa.schema(
        [("hash", pa.int64()), ("salt", pa.int32()), ("split", pa.bool_()), ("row", pa.int64()), ("start", pa.int64()),
         ("windows", pa.int32()), ("at", pa.int32()), ("region", pa.binary())]
    )
    for b in batches:
        out: list[tuple] = []
        held = 0
        texts = as_bytes(b.column("text"))
        for row, text, found in zip(b.column("row").to_pylist(), texts, b.column("found").to_pylist()):
            for f in found:
                first, more = f["spot"] >> 32, f["spot"] & (1 << 32) - 1
                region = text[first : first + more + length]
                shards = -(-f["n"] // share)
                salt = xxhash.xxh3_64_intdigest(b"%d %d" % (row, first)) % shards
                out.append((f["hash"], salt, shards > 1, row, first, more + 1, f["at"], region))
                held += len(region)
                if held > 8 << 20:
                    yield batch(schema, *zip(*out))
                    out, held = [], 0
        if out:
            yield batch(schema, *zip(*out))


#: What a found span is: of strings of ``length``, of ``passage`` bytes, or of both.
LONG, SHORT = 1, 2
_FOUND = pa.schema(
    [("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("sure", pa.bool_())]
)
_FOUND_DDL = "row long, start long, end long, kind int, k1 long, k2 long, sure boolean"
Owners = list[tuple[int, int]]
Region = list  # of the number of windows, the owners and the anchor's place


def _with_partners(group: dict[bytes, Region], gram: int, side: int) -> list[bytes]:
    """The regions that agree with another one in the ``side`` bytes before or after the anchor.

    Equal windows have the anchor at the same place, and ``side`` bytes at least on one side of it.
    """
    keys = [(r[max(0, at - side) : at], r[at + gram : at + gram + side]) for r, (_, _, at) in group.items()]
    before, after = (Counter(x) for x in zip(*keys))
    return [r for r, (x, y) in zip(group, keys) if before[x] > 1 or after[y] > 1]


def _rows_differ(own: Owners) -> bool:
    return any(row != own[0][0] for row, _ in own)


class _Shard:
    """Regions with their owners; equal regions are held once."""

    def __init__(self, length: int, passage: int):
        self.length, self.passage = length, passage
        self.size = 0
        self.groups: list[tuple[dict[bytes, Region], list[bytes], bool]] = []

    def add(self, group: dict[bytes, Region], some: list[bytes], split: bool) -> None:
        """Regions of one anchor; ``some`` of them go into the suffix array."""
        self.groups.append((group, some, split))
        self.size += sum(map(len, some))

    def repeats(self) -> pa.RecordBatch | None:
        """Runs of repeated windows as (row, start, end), and published windows of split anchors."""
        out: list[tuple] = []
        strings: list[bytes] = []
        owners: list[Owners] = []
        windows: list[int] = []
        splits: list[bool] = []
        for group, some, split in self.groups:
            for region, (_, own, _) in group.items():
                if len(own) > 1:  # every window of it occurs in each of its owners
                    kind = LONG * (len(region) >= self.length) + SHORT * _rows_differ(own)
                    if kind:
                        out += [(row, start, start + len(region), kind, None, None, None) for row, start in own]
            strings += some
            windows += [group[r][0] for r in some]
            owners += [group[r][1] for r in some]
            splits += [split] * len(some)
        self.groups, self.size = [], 0
        if strings:
            self._sorted(strings, windows, owners, splits, out)
        return batch(_FOUND, *zip(*out)) if out else None

    def _sorted(self, strings: list[bytes], windows: list[int], owners: list[Owners], splits: list[bool], out: list[tuple]) -> None:
        text = np.frombuffer(b"".join(strings), np.uint8)
        n = np.array([len(s) for s in strings])
        first = np.cumsum(n) - n
        ends = np.repeat(first + n, n)
        # Passages that start beyond a region's own windows are other regions' to find.
        own_window = np.arange(len(text)) < np.repeat(first + windows, n)
        left = ends - np.arange(len(text))
        depths = [self.passage, self.length] if self.passage < self.length else [self.length]
        classes = prefix_classes(text, ends, depths, [own_window & (left >= d) for d in depths])
        rows = np.array([o[0][0] for o in owners])
        starts = np.array([o[0][1] for o in owners])
        number = np.unique(rows, return_inverse=True)[1]
        split = np.array(splits)
        bits, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
        for kind, least, of in ((LONG, self.length, classes[-1]), (SHORT, self.passage, classes[0])):
            # Classes of equal windows; shorter suffixes hold no window.
            whole = np.flatnonzero((left >= least) & own_window)
            if not len(whole):
                continue
            order = of[whole].astype(np.uint64) << bits | whole.astype(np.uint64)
            order.sort()
            place, label = (order & mask).astype(np.int64), order >> bits
            heads = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            size = np.diff(np.r_[heads, len(place)])
            member = np.searchsorted(first, place, side="right") - 1
            row = number[member]
            at = place - first[member] + starts[member]
            # A removed window's other place may be in its own text, a passage's has to be in another. Regions
            # of one text may overlap, and a place isn't its own repeat.
            real = row.astype(np.int64) << 40 | at if kind == LONG else row
            several = np.array([len(o) > 1 and (kind == LONG or _rows_differ(o)) for o in owners])
            twice = np.minimum.reduceat(real, heads) != np.maximum.reduceat(real, heads)
            twice |= np.logical_or.reduceat(several[member], heads)
            sure = np.repeat(twice, size)
            spot = np.sort(place[sure & ~several[member]])
            if len(spot):
                own = np.searchsorted(first, spot, side="right") - 1
                new = np.r_[True, (np.diff(spot) != 1) | (np.diff(own) != 0)]
                a, z = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(spot)] - 1
                lo = spot[a] - first[own[a]] + starts[own[a]]
                hi = spot[z] - first[own[z]] + starts[own[z]] + least
                out += [(int(rows[o]), int(x), int(y), kind, None, None, None) for o, x, y in zip(own[a], lo, hi)]
            if split.any():
                # One window of each class tells of it; of one that isn't known to repeat, all may be hit.
                head = np.zeros(len(place), bool)
                head[heads] = True
                for h in np.flatnonzero(split[member] & (head | ~sure)).tolist():
                    m, p = int(member[h]), int(place[h])
                    key = np.frombuffer(xxhash.xxh3_128_digest(bytes((kind,)) + text[p : p + least].tobytes()), np.int64)
                    out.append((int(rows[m]), int(at[h]), int(at[h]) + least, kind, int(key[0]), int(key[1]), bool(sure[h])))


def _shards(batches: Iterator[pa.RecordBatch], length: int, passage: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Regions, sorted by anchor and salt, to the repeats of each shard."""
    shard = _Shard(length, passage)
    now, group, size, split = None, {}, 0, False

    def closed() -> Iterator[pa.RecordBatch]:
        some = list(group) if split else _with_partners(group, gram, -(-(passage - gram) // 2)) if len(group) > 1 else []
        if some or any(len(own) > 1 for _, own, _ in group.values()):
            if shard.size and shard.size + sum(map(len, some)) > SHARD_BYTES:
                found = shard.repeats()
                if found is not None:
                    yield found
            shard.add(group, some, split)

    for b in batches:
        for h, salt, is_split, row, start, windows, at, region in zip(*(c.to_pylist() for c in b.columns)):
            if (h, salt) != now or size + len(region) > LONGEST - 1000:
                # What one shard can't hold of an anchor is dealt on, and its windows are published.
                over = (h, salt) == now
                split = split or over
                if group:
                    yield from closed()
                now, group, size, split = (h, salt), {}, 0, is_split or over
            held = group.get(region)
            if held is None:
                group[region] = [windows, [(row, start)], at]
                size += len(region)
                continue
            own = held[1]
            held[0] = max(held[0], windows)  # at a text's end a region has more windows of a passage
            if (row, start) not in own[:1] and (len(own) < 2 or own[-1] != (row, start)):
                own.append((row, start))
    if group:
        yield from closed()
    found = shard.repeats()
    if found is not None:
        yield found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Published windows, sorted by digest: those that more than one shard has."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
    for piece in sorted_runs(batches, "k1"):
        k = np.empty(len(piece["k1"]), [("a", np.int64), ("b", np.int64)])
        k["a"], k["b"] = piece["k1"], piece["k2"]
        pair = np.unique(k, return_inverse=True)[1]
        order = np.argsort(pair, kind="stable")
        merged = pair[order]
        lo, hi = np.searchsorted(merged, pair, "left"), np.searchsorted(merged, pair, "right")
        heads = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        row, sure = piece["row"][order], piece["sure"].astype(bool)
        other = np.minimum.reduceat(row, heads) != np.maximum.reduceat(row, heads)
        other |= np.logical_or.reduceat(sure[order], heads)
        hit = (hi - lo > 1) & ~sure & (other[pair] | (piece["kind"] == LONG))
        if hit.any():
            yield batch(schema, *(piece[n][hit] for n in schema.names))


def _joined(found: list[tuple[int, int]]) -> list[int]:
    """Starts and ends in turn of the runs that the spans make up together."""
    out: list[int] = []
    for a, z in sorted(found):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += (a, z)
    return out


_CUT = pa.schema(
    [("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
     ("spans", pa.list_(pa.int64())), ("n_shared", pa.int64())]
)
_CUT_DDL = "key binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>, n_shared long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_bytes(b.column("text"))
        for key, text, found in zip(b.column("key").to_pylist(), texts, b.column("found").to_pylist()):
            spans, shared = (_joined([(f["start"], f["end"]) for f in found if f["kind"] & k]) for k in (LONG, SHORT))
            kept, at = hashlib.sha256(), 0
            for a, z in zip(spans[::2], spans[1::2]):
                kept.update(text[at:a])
                at = z
            kept.update(text[at:])
            removed, reported = (sum(x[1::2]) - sum(x[::2]) for x in (spans, shared))
            yield batch(_CUT, [key], [removed], [len(spans) // 2], [kept.hexdigest()], [spans], [reported])


def remove_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, share: int = SHARE, passage: int = PASSAGE
) -> DataFrame:
    """Removes from documents (doc_id, text) each byte of a string of ``length``
    bytes that starts at another place too, of the same or another document.

    Returns for each row doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    spans (starts and ends of the removed runs in turn) and n_shared: the bytes
    of strings of ``passage`` bytes, from ``gram`` up to ``length``, that another
    row has too. Null texts are empty; shorter texts than ``length`` lose nothing.
    Of repeated rows every one loses all of a long text. Texts of any length are
    taken whole.
    """
    if not gram <= passage <= length:
        raise ValueError("a passage must be as long as a gram and no longer than a removed string")
    scratch = Scratch(spark, "substring")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select("doc_id", body.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    rows = keyed.mapInArrow(
        lambda x: _anchored(x, passage, gram),
        "doc_id long, key binary, n_bytes long, sha256 string, hash array<long>, first array<int>, last array<int>, at array<int>",
    )
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # Equal texts are looked at once.
    texts = rows.groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("n_bytes").alias("n"))
    texts = scratch.save(texts, "texts")
    one = rows.join(texts.select("rep"), F.col("row") == F.col("rep"), "left_semi")
    each = one.select("row", F.explode(F.arrays_zip("hash", "first", "last", "at")).alias("x"))
    # Rows of anchors are most of what is moved, so they are kept narrow: an anchor's windows and first place make one number.
    spot = F.shiftleft(F.col("x.first").cast("long"), 32).bitwiseOR((F.col("x.last") - F.col("x.first")).cast("long"))
    each = scratch.save(each.select("row", "x.hash", spot.alias("spot"), (F.col("x.at") - F.col("x.first")).alias("at")), "each")
    slim = scratch.save(rows.select("row", "doc_id", "key", "n_bytes", "sha256"), "slim")
    scratch.drop("rows")
    often = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("hash", "h")
    often = scratch.save(often, "often")
    found = each.join(often, F.col("hash") == F.col("h")).groupBy("row")
    found = found.agg(F.collect_list(F.struct("hash", "spot", "at", "n")).alias("found")).withColumnRenamed("row", "r")
    found = slim.join(found, F.col("row") == F.col("r")).select("row", F.col("key").alias("k"), F.col("doc_id").alias("d"), "found")
    held = keyed.join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    held = scratch.save(held.select("row", "key", "text", "found"), "held")
    scratch.drop("each")
    scratch.drop("often")

    regions = held.select("row", "text", "found").mapInArrow(
        lambda x: _regions(x, length, share), "hash long, salt int, split boolean, row long, start long, windows int, at int, region binary"
    )
    dealt = regions.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    seen = scratch.save(dealt.mapInArrow(lambda x: _shards(x, length, passage, gram), _FOUND_DDL), "seen")
    open_ = seen.where("k1 IS NOT NULL").repartition("k1").sortWithinPartitions("k1", "k2")
    met = open_.mapInArrow(_met, "row long, start long, end long, kind int")
    spans = seen.where("k1 IS NULL").select("row", "start", "end", "kind").unionByName(met)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("found")).withColumnRenamed("row", "r")
    cut = held.select("row", "key", "text").join(spans, F.col("row") == F.col("r"))
    cut = cut.select("key", "text", "found").mapInArrow(_cut, _CUT_DDL)
    zero, all_ = F.lit(0).cast("long"), F.col("n") >= length
    copied = texts.where((F.col("copies") > 1) & (F.col("n") >= passage)).select(
        "key", F.when(all_, F.col("n")).alias("n_removed"), F.when(all_, F.lit(1).cast("long")).alias("n_spans"),
        F.when(all_, F.lit(hashlib.sha256().hexdigest())).alias("kept_sha256"), F.when(all_, F.array(zero, "n")).alias("spans"),
        F.col("n").alias("n_shared"),
    )
    cut = cut.join(copied.select("key"), "key", "left_anti").dropDuplicates(["key"]).unionByName(copied)
    cut = scratch.save(cut.withColumnRenamed("key", "k"), "cut")
    out = slim.join(cut, F.col("key") == F.col("k"), "left")
    out = out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
        F.coalesce("n_shared", zero).alias("n_shared"),
    )
    return scratch.finish(out)
