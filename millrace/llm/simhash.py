"""Near-duplicate documents by SimHash, with deletion-variant signatures.

A fingerprint of 64 bits is cut into ``bits // 2 + 1`` segments. Two fingerprints
that differ in at most ``bits`` places have a segment in which they differ in
one place at most, so with one suitable bit of that segment deleted they are
equal. Each fingerprint is indexed under every segment with every one of its
bits deleted; equal keys meet, and the whole fingerprints are compared.

A segment value that more than ``HOT`` fingerprints share would make its
buckets large. Such fingerprints, and those one bit away in that segment, are
linked through midpoints instead: two fingerprints are ``bits`` or fewer apart
exactly if flipping up to half as many bits of each leads to a common value.
That costs a fixed number of rows for each of them, whatever the group's size.

Fingerprints of texts whose shingle sets have a similarity of 0.8 differ in some
ten of 64 bits, and no segments wide enough for large tables survive that. So
``keep_first``, which is to find such texts, has bands of least shingle hashes as
further candidates: a fixed number of rows for each text, equal keys meet too, and
each candidate of either kind is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .components import components
from .runtime import Scratch, as_bytes, batch, sorted_runs

HOT = 1024
SEED = 42
#: Bands of so many least hashes each: 0.99 of the pairs at a similarity of 0.8 have one in common.
BANDS, BAND_HASHES = 24, 8


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each word shingle, a row of 8 bytes for each; none if the text has no word."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) < width:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)


def _fingerprint(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes, width: int) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    return _fingerprint(_shingle_hashes(text, width))


@lru_cache(4)
def _factors(n: int) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh64_digest(b"%d" % i, SEED) for i in range(n)), ">u8").astype(np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray, n: int, least: int) -> list[int]:
    """``n`` keys, each of the ``least`` least hashes of the shingles in as many orders; none without shingles.

    Two texts have a band in common with probability 1 - (1 - s ** least) ** n, where s is
    the similarity of their shingle sets.
    """
    if not len(hashes):
        return []
    factors, out = _factors(n * least), np.full(n * least, (1 << 64) - 1, np.uint64)
    h = hashes.view(">u8").astype(np.uint64)
    for lo in range(0, len(h), 1 << 12):
        np.minimum(out, (h[lo : lo + (1 << 12)] * factors).min(axis=0), out=out)
    parts = out.reshape(n, least)
    return [xxhash.xxh3_64_intdigest(parts[i].tobytes(), i) - (1 << 63) for i in range(n)]


def words_digest(text: bytes) -> bytes:
    """128 bits that are equal for texts of the same words in the same order, whose shingles are the same."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def with_fingerprint(df: DataFrame, text: str, width: int) -> DataFrame:
    """Adds the fingerprint as fp; the other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x, width) for x in as_bytes(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "fp"])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("fp", LongType(), False))


def with_sketch(df: DataFrame, text: str, width: int, n: int, least: int) -> DataFrame:
    """Adds the fingerprint, the digest of the words and the bands; the other columns pass through."""
    more = StructType().add("fp", LongType(), False).add("digest", BinaryType(), False).add("bands", ArrayType(LongType(), False), False)
    types = [pa.int64(), pa.binary(), pa.list_(pa.field("element", pa.int64(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in as_bytes(b.column(text)):
                hashes = _shingle_hashes(x, width)
                rows.append((_fingerprint(hashes), words_digest(x), bands(hashes, n, least)))
            found = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *more.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *more.fields]))


def _variants(
    batches: Iterator[pa.RecordBatch], parts: list[tuple[int, int]], more: tuple[str, ...] = ()
) -> Iterator[pa.RecordBatch]:
    """(key, fp, more) for each deleted bit of the segments that are not hot."""
    schema = pa.schema([(n, pa.int64()) for n in ("key", "fp", *more)])
    for b in batches:
        rest = [b.column(n).to_numpy() for n in more]
        signed = b.column("fp").to_numpy()
        cold = b.column("cold").to_numpy()
        fp = signed.view(np.uint64)
        for i, (low, n) in enumerate(parts):
            pick = (cold >> i) & 1 == 1
            value = (fp[pick] >> np.uint64(low)) & np.uint64((1 << n) - 1)
            for bit in range(n):
                key = (value & ~np.uint64(1 << bit)).view(np.int64) * 64 + (low + bit)
                yield batch(schema, key, signed[pick], *(r[pick] for r in rest))


Near = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _segment_near(parts: list[tuple[int, int]], bits: int) -> Near:
    """Whether two fingerprints of a place's bucket are near and meet there first."""
    low_of = np.array([low for low, n in parts for _ in range(n)], np.uint64)
    mask_of = np.array([(1 << n) - 1 for _, n in parts for _ in range(n)], np.uint64)
    first = np.zeros(64, bool)
    first[[low for low, _ in parts]] = True

    def near(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        diff = x ^ y
        # Equal segments meet under every deleted bit; the first one is enough.
        differs = ((diff >> low_of[place]) & mask_of[place]) != 0
        return (np.bitwise_count(diff) <= bits) & (differs | first[place])

    return near


def _linked(batches: Iterator[pa.RecordBatch], parts: list[tuple[int, int]], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each bucket: all of them where they are few, else a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    near = _segment_near(parts, bits)
    for piece in sorted_runs(batches, "key"):
        key, signed = piece["key"], piece["fp"]
        fp, place = signed.view(np.uint64), (key & 63).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= 8, sizes)
        out_a, out_b = [], []
        for step in range(1, 8):
            if len(key) <= step:
                break
            i = np.flatnonzero((key[step:] == key[:-step]) & small[:-step])
            if not len(i):
                break
            hit = i[near(fp[i], fp[i + step], place[i])]
            out_a.append(signed[hit])
            out_b.append(signed[hit + step])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            own, at = fp[s : s + n], place[s : s + 1]
            if n <= 1024:
                meets = near(own[:, None], own[None, :], at)
                x, y = np.nonzero(np.triu(meets, 1))
                if len(x) <= 4 * n:
                    out_a.append(signed[s + x])
                    out_b.append(signed[s + y])
                    continue
            free = np.ones(n, bool)
            while free.any():
                stack = [int(np.argmax(free))]
                free[stack[0]] = False
                while stack:
                    x = stack.pop()
                    rest = np.flatnonzero(free)
                    new = rest[near(own[rest], own[x], at)] if len(rest) else rest
                    free[new] = False
                    stack += new.tolist()
                    out_a.append(np.repeat(signed[s + x], len(new)))
                    out_b.append(signed[s + new])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield batch(schema, np.minimum(a, b), np.maximum(a, b))


def _midpoints(batches: Iterator[pa.RecordBatch], bits: int, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("key", "fp", *more)])
    half = (bits + 1) // 2
    flips = np.array([sum(1 << p for p in c) for n in range(half + 1) for c in combinations(range(64), n)], np.uint64)
    for b in batches:
        columns = [b.column(n).to_numpy() for n in ("fp", *more)]
        for i in range(0, b.num_rows, 64):
            part = [c[i : i + 64] for c in columns]
            key = (part[0].view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield batch(schema, key, *(np.repeat(c, len(flips)) for c in part))


def _stars(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links each value that shares a midpoint with the least that does; bits is even."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for piece in sorted_runs(batches, "key"):
        key, fp = piece["key"], piece["fp"]
        head = np.r_[True, key[1:] != key[:-1]]
        hub = fp[np.flatnonzero(head)][np.cumsum(head) - 1]
        rest = hub != fp
        yield batch(schema, np.minimum(hub, fp)[rest], np.maximum(hub, fp)[rest])


def hot_size(bits: int) -> int:
    """From which size on a segment value's fingerprints are linked through midpoints:
    where that is no more rows than comparisons."""
    return max(HOT, sum(comb(64, n) for n in range(bits // 2 + 1)) // 16)


def _states(scratch: Scratch, prints: DataFrame, bits: int, hot: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(fp, cold) with the segments that are not hot as bits, and (fp) of those that go
    through midpoints, None if none does; ``prints.fp`` are distinct."""
    if bits % 2:
        raise ValueError("bits must be even")
    hot = hot_size(bits) if hot is None else hot
    parts = segments(bits)
    value = [
        F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1).cast("long")) * 64 + i
        for i, (low, n) in enumerate(parts)
    ]
    seen = prints.select(F.explode(F.array(*value)).alias("v")).groupBy("v").count()
    crowded = scratch.save(seen.where(F.col("count") > hot).select("v"), "crowded")
    whole = (1 << len(parts)) - 1
    cold, warm = prints.select("fp", F.lit(whole).alias("cold")), None
    if not crowded.isEmpty():
        place = F.pmod("v", F.lit(64))
        sides = [
            F.when(place == i, F.array(*[F.col("v").bitwiseXOR(F.lit(64 << p)) for p in range(n)]))
            for i, (_, n) in enumerate(parts)
        ]
        around = crowded.select(F.explode(F.coalesce(*sides)).alias("v"), F.lit(0).alias("is_hot"))
        around = around.unionByName(crowded.select("v", F.lit(1).alias("is_hot")))
        around = scratch.save(around.groupBy("v").agg(F.max("is_hot").alias("is_hot")), "around")
        each = prints.select("fp", F.posexplode(F.array(*value)).alias("i", "v"))
        met = each.join(around, "v", "left")
        bit = F.expr("shiftleft(1, i)")
        state = met.groupBy("fp").agg(
            F.sum(F.when(F.col("is_hot") == 1, 0).otherwise(bit)).cast("int").alias("cold"),
            F.count("is_hot").alias("warm"),
        )
        state = scratch.save(state, "state")
        cold, warm = state.select("fp", "cold"), state.where("warm > 0").select("fp")
    return cold, warm


def links(scratch: Scratch, prints: DataFrame, bits: int, hot: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``prints.fp``
    which are ``bits`` (even) or fewer apart; links implied by others may be left out."""
    cold, warm = _states(scratch, prints, bits, hot)
    parts = segments(bits)
    rows = cold.mapInArrow(lambda x: _variants(x, parts), "key long, fp long")
    found = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
        lambda x: _linked(x, parts, bits), "a long, b long"
    )
    if warm is not None:
        rows = warm.mapInArrow(lambda x: _midpoints(x, bits), "key long, fp long")
        stars = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
            lambda x: _stars(x, bits), "a long, b long"
        )
        found = found.unionByName(stars)
    return found


def classes(scratch: Scratch, prints: DataFrame, bits: int, hot: int | None = None) -> DataFrame:
    """(fp, component_id) for each distinct fp of ``prints`` (fp, doc_id); component_id
    is the least doc_id of all fingerprints that links lead to, null if all are null."""
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(scratch, nodes, bits, hot)
    labels = components(scratch, found)
    named = nodes.join(labels, nodes.fp == labels.node, "left")
    named = scratch.save(named.select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    least = scratch.save(least, "least")
    return scratch.save(named.join(least, "label").select("fp", "component_id"), "classes")


def simhash_components(
    spark: SparkSession, docs: DataFrame, width: int = 4, bits: int = 4, hot: int | None = None
) -> DataFrame:
    """Fingerprints and near-duplicate groups of documents (doc_id, text).

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, a row
    for each row. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Rows may repeat. Null doc_ids are kept and never
    name a group unless it has no other. Other columns are ignored. An empty
    table gives an empty result.
    """
    scratch = Scratch(spark, "simhash")
    rows = with_fingerprint(docs.select("doc_id", "text"), "text", width).select("doc_id", "fp")
    rows = scratch.save(rows, "rows")
    group = classes(scratch, rows, bits, hot)
    out = rows.join(group, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
    return scratch.finish(out)


def similarity(x: bytes, y: bytes, width: int) -> float:
    """Jaccard similarity of the sets of word shingles; texts of fewer words are one shingle, blank ones none."""

    def shingles(text: bytes) -> set[bytes]:
        words = text.lower().split()
        return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b) if a or b else 1.0


def _similar(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for t in batches:
        texts = zip(as_bytes(t.column("x")), as_bytes(t.column("y")))
        keep = np.array([similarity(x, y, width) >= least for x, y in texts], bool)
        if keep.any():
            yield batch(schema, t.column("a").to_numpy()[keep], t.column("b").to_numpy()[keep])


def similar_links(scratch: Scratch, rows: DataFrame, text: str, found: DataFrame, width: int, least: float) -> DataFrame:
    """The links (a, b) of rows whose texts are as similar as ``least``.

    Only texts that have a link are moved. All tables that meet are written
    ones, so that the rows of a text with many links can be split among tasks.
    """
    found = scratch.save(found.distinct(), "found")
    # Shuffled at every size: how much is kept grows with the documents, and isn't for broadcasting.
    ends = scratch.save(found.select(F.explode(F.array("a", "b")).alias("e")).distinct(), "ends").hint("merge")
    texts = rows.select("row", text).join(ends, F.col("row") == F.col("e"), "left_semi")
    texts = scratch.save(texts.select("row", F.col(text).alias("text")), "linked")
    x, y = (texts.select(F.col("row").alias(f"row_{n}"), F.col("text").alias(n)) for n in "xy")
    pairs = found.join(x, found.a == F.col("row_x")).join(y, found.b == F.col("row_y")).select("a", "b", "x", "y")
    return scratch.save(pairs.mapInArrow(lambda t: _similar(t, width, least), "a long, b long"), "similar")


#: Links (a, b), and members (fp, a) of dense groups (key, root) not all of whose pairs were links yet.
_LOOKED = pa.schema([("open", pa.bool_()), *((n, pa.int64()) for n in ("key", "root", "fp", "a", "b"))])
_LOOKED_DDL = "open boolean, key long, root long, fp long, a long, b long"


def _links_out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    return batch(_LOOKED, np.zeros(len(a), bool), zero, zero, zero, np.minimum(a, b), np.maximum(a, b))


def _members_out(key: np.ndarray, root: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return batch(_LOOKED, np.ones(len(key), bool), key, root, fp, node, node)


def _first_look(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """All links of each bucket (key, fp, node) where they are few, else a spanning forest
    and, as links may fail their check, the members of its trees."""
    for piece in sorted_runs(batches, "key"):
        key, signed, node = piece["key"], piece["fp"], piece["node"]
        fp = signed.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= 8, sizes)
        out_a, out_b = [], []
        for step in range(1, 8):
            if len(key) <= step:
                break
            i = np.flatnonzero((key[step:] == key[:-step]) & small[:-step])
            if not len(i):
                break
            hit = i[near(fp[i], fp[i + step], key[i])]
            out_a.append(node[hit])
            out_b.append(node[hit + step])
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            own, ids, at = fp[s : s + n], node[s : s + n], key[s : s + 1]
            few_a, few_b, total = [], [], 0
            rows = max(1, (1 << 20) // n)
            for lo in range(0, n, rows):
                x, y = np.nonzero(np.triu(near(own[lo : lo + rows, None], own[None, lo:], at), 1))
                total += len(x)
                if total > 4 * n:
                    break
                few_a.append(ids[lo + x])
                few_b.append(ids[lo + y])
            if total <= 4 * n:
                out_a += few_a
                out_b += few_b
                continue
            free = np.ones(n, bool)
            while free.any():
                stack = [int(np.argmax(free))]
                free[stack[0]] = False
                tree = [np.array(stack)]
                while stack:
                    x = stack.pop()
                    rest = np.flatnonzero(free)
                    new = rest[near(own[rest], own[x], at)] if len(rest) else rest
                    free[new] = False
                    stack += new.tolist()
                    tree.append(new)
                    out_a.append(np.repeat(ids[x], len(new)))
                    out_b.append(ids[new])
                members = np.sort(np.concatenate(tree))
                if len(members) > 2:
                    of = ids[members]
                    yield _members_out(np.repeat(at, len(of)), np.repeat(of[:1], len(of)), signed[s + members], of)
        if out_a:
            yield _links_out(np.concatenate(out_a), np.concatenate(out_b))


def shingle_sets(rows: DataFrame, text: str, width: int) -> DataFrame:
    """(member, shingles): the hashes of the shingles of the texts of rows (row, text), each once."""
    schema = pa.schema([("member", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (_shingle_hashes(x, width).view(np.int64).ravel() for x in as_bytes(b.column(text)))
            yield batch(schema, b.column("row"), [np.unique(x) for x in found])

    return rows.select("row", text).mapInArrow(run, "member long, shingles array<long>")


def _forest(near: Callable[[int], np.ndarray] | None, label: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places whose sets are as similar as ``least`` (and near), that connect all such pairs of different labels.

    Each set outside the largest component is compared with all others, by the lists of the sets that have a value.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    head = np.r_[True, np.diff(values[order]) != 0][: len(values)]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(head) - 1
    own, start = owner[order], np.flatnonzero(head)
    long = np.diff(np.r_[start, len(values)])
    begin = np.cumsum(size) - size
    names, of, times = np.unique(label, return_inverse=True, return_counts=True)
    main, out = int(times.argmax()), []
    for i in range(n):
        if of[i] == main:
            continue
        mine, common = number[begin[i] : begin[i] + size[i]], np.zeros(n, np.int64)
        part = np.cumsum(long[mine]) >> 22
        for piece in np.split(mine, np.flatnonzero(np.diff(part)) + 1):
            count_ = long[piece]
            place = np.repeat(start[piece] - np.cumsum(count_) + count_, count_) + np.arange(count_.sum())
            common += np.bincount(own[place], minlength=n)
        hit = (of != of[i]) & (common / np.maximum(1, size + size[i] - common) >= least)
        if near:
            hit &= near(i)
        for j in np.flatnonzero(hit).tolist():
            if of[i] != of[j]:
                out.append((i, j))
                x, y = (of[i], of[j]) if of[i] == main else (of[j], of[i])
                of[of == y] = x
    return out


_INSIDE = ("way", "key", "root")


def _inside(batches: Iterator[pa.RecordBatch], bits: int, least: float) -> Iterator[pa.RecordBatch]:
    """Groups (way, key, root) with members (fp, a, label, shingles), sorted, to links that connect what is alike in each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        label, node, fp = (t.column(n).to_numpy() for n in ("label", "a", "fp"))
        if (label == label[0]).all():
            return
        sets = [x for part in t.column("shingles").chunks for x in part.to_numpy(zero_copy_only=False)]
        fp = fp.view(np.uint64)
        near = None if t.column("way")[0].as_py() == BY_BAND else lambda i: np.bitwise_count(fp ^ fp[i]) <= bits
        found = np.array(_forest(near, label, sets, least), np.int64).reshape(-1, 2)
        a, b = node[found[:, 0]], node[found[:, 1]]
        yield batch(schema, np.minimum(a, b), np.maximum(a, b))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(n).to_numpy() for n in _INSIDE]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]).tolist()
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            if held and any(held[0].column(n)[0].as_py() != c[s] for n, c in zip(_INSIDE, columns)):
                yield from links_of(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield from links_of(held)


#: The number of the bands among the ways in which candidates meet.
BY_BAND = 1


def verified_components(
    scratch: Scratch, nodes: DataFrame, bits: int, check: Callable[[Scratch, DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame], least: float, hot: int | None = None,
) -> DataFrame:
    """(node, label) for the nodes of ``nodes`` (node, fp, bands) that have links; equal labels mean the
    same component of the links that ``check`` keeps, of all between nodes whose fingerprints are ``bits``
    or fewer apart or that have a band in common.

    A link is left out only if links that were checked connect its ends. Where a bucket
    has many links, a forest is checked first. If that leaves members apart, they meet once more with
    their ``sets`` (member, shingles of those whose nodes are given as e), are compared where they meet, and only
    links that connect them go on to ``check``: fewer than members, however many pairs aren't alike.
    """
    prints = scratch.save(nodes.select("fp").distinct(), "prints")
    cold, warm = _states(scratch, prints, bits, hot)
    parts = segments(bits)
    cold = cold.join(nodes.select("fp", "node"), "fp").select("fp", "cold", "node")
    at_segments = _segment_near(parts, bits)
    ways: list[tuple[DataFrame, Near]] = [
        (cold.mapInArrow(lambda x: _variants(x, parts, ("node",)), "key long, fp long, node long"),
         lambda x, y, key: at_segments(x, y, key & 63)),
        (nodes.select(F.explode("bands").alias("key"), "fp", "node"), lambda x, y, key: np.ones(np.broadcast_shapes(x.shape, y.shape), bool)),
    ]
    if warm is not None:
        warm = warm.join(nodes.select("fp", "node"), "fp").select("fp", "node")
        # All that share a midpoint are near; equal ones share all midpoints, and their own is enough.
        ways.append(
            (warm.mapInArrow(lambda x: _midpoints(x, bits, ("node",)), "key long, fp long, node long"),
             lambda x, y, key: (x != y) | (x == key.view(np.uint64)))
        )
    looked = []
    for w, (rows, near) in enumerate(ways):
        rows = rows.repartition("key").sortWithinPartitions("key", "fp", "node")
        rows = scratch.save(rows.mapInArrow(lambda x, near=near: _first_look(x, near), _LOOKED_DDL), f"looked{w}")
        looked.append(rows.withColumn("way", F.lit(w)))
    every = reduce(DataFrame.unionByName, looked)
    inner = scratch.inner("forests")
    kept = check(inner, every.where("NOT open").select("a", "b"))
    labels = components(inner, kept)
    named = labels.withColumnRenamed("node", "n")
    members = every.where("open").join(named, F.col("a") == F.col("n"), "left")
    members = scratch.save(members.select(*_INSIDE, "fp", "a", F.coalesce("label", "a").alias("label")), "members")
    groups = members.groupBy(*_INSIDE).agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"),
        F.expr("bit_xor(xxhash64(a))").alias("x"), F.expr("bit_xor(xxhash64(a, 1))").alias("y"),
    )
    # Of groups of the same members one is enough: all their pairs that are near, or all, are compared in it.
    groups = groups.where("low < high").groupBy(F.col("way") == BY_BAND, "n", "x", "y").agg(F.min(F.struct(*_INSIDE)).alias("g"))
    groups = scratch.save(groups.select(*[F.col(f"g.{c}").alias(f"g_{c}") for c in _INSIDE]), "groups").hint("merge")
    if groups.isEmpty():
        return labels
    apart = members.join(groups, [F.col(c) == F.col(f"g_{c}") for c in _INSIDE], "left_semi")
    apart = scratch.save(apart, "apart")
    own = scratch.save(sets(apart.select(F.col("a").alias("e")).distinct()), "sets").hint("merge")
    rows = apart.join(own, F.col("a") == F.col("member")).select(*_INSIDE, "fp", "a", "label", "shingles")
    rows = rows.repartition(*_INSIDE).sortWithinPartitions(*_INSIDE, "fp", "a")
    more = scratch.save(rows.mapInArrow(lambda x: _inside(x, bits, least), "a long, b long"), "more")
    inner = scratch.inner("inside")
    return components(inner, kept.unionByName(check(inner, more)))


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5, bits: int = 4, least: float = 0.8) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the least doc_id.

    Documents are linked whose sets of word shingles have a similarity of ``least``
    or more, of those whose fingerprints are ``bits`` or fewer apart or that have one
    of ``BANDS`` bands in common. All columns of ``docs`` are returned as they are. Of
    repeated doc_ids in a group one row stays; a null doc_id stays only if its group
    has no other. Null, empty and blank texts are alike.
    """
    scratch = Scratch(spark, "keep")
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text, key = (f"c{names.index(c)}" for c in ("text", "doc_id"))
    rows = with_sketch(inner, text, width, BANDS, BAND_HASHES).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    # Only texts of equal words are one node unverified; equal fingerprints may have other texts.
    first = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("doc_id"), "row")).alias("first")
    same = [F.min("fp").alias("fp"), F.min("bands").alias("bands")]  # equal in all rows of a digest
    nodes = scratch.save(rows.groupBy("digest").agg(*same, F.min("row").alias("node"), first), "nodes")

    def sets(ends: DataFrame) -> DataFrame:
        return shingle_sets(rows.join(ends.hint("merge"), F.col("row") == F.col("e"), "left_semi"), text, width)

    labels = verified_components(
        scratch, nodes.select("node", "fp", "bands"), bits, lambda s, found: similar_links(s, rows, text, found, width, least), sets, least
    )
    labels = labels.withColumnRenamed("node", "n")
    # One row for each group: a group's component_id may be shared by others if ids repeat.
    named = nodes.join(labels, nodes.node == labels.n, "left").select(F.coalesce("label", "node").alias("label"), "first")
    first = named.groupBy("label").agg(F.min("first").alias("first"))
    kept = scratch.save(first.select(F.col("first.row").alias("kept")), "kept")
    out = rows.join(kept.hint("merge"), F.col("row") == F.col("kept"), "left_semi")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
