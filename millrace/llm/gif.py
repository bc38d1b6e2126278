"""GIF media columns: encoder, decoder and colour features.

The decoder reads LZW code streams, local and global palettes, interlacing,
transparency and disposal, and gives frames as they are shown with their times.
The encoder writes 8-bit samples as frames of one grey palette, each frame
with an LZW stream of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import as_bytes, batch

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 10  # hundredths of a second
LEVELS = 8  # of each of red, green and blue in the histograms
GREY = bytes(v for i in range(256) for v in (i, i, i))
_WIDTH = np.array([min(12, max(9, (258 + max(0, k - 1)).bit_length())) for k in range(4096)], np.int64)

#: Widths of a stream's codes, the clear code first, and the bits up to the end of each.
_BITS = np.r_[9, _WIDTH]
_ENDS = np.cumsum(_BITS)


def lzw_codes(data: bytes) -> list[int]:
    """LZW codes of 8-bit samples, without clear and end codes; as many as fit the first table."""
    table: dict[int, int] = {}
    get = table.get
    out: list[int] = []
    add = out.append
    stream = iter(data)
    last, free = next(stream), 258
    for c in stream:
        key = last << 8 | c
        found = get(key)
        if found is None:
            add(last)
            table[key] = free
            free += 1
            last = c
        else:
            last = found
    add(last)
    return out


def pack(streams: list[list[int]]) -> list[bytes]:
    """Bits of several code streams, least significant first, each from a byte boundary on."""
    n = np.array([len(s) + 2 for s in streams])
    first = np.r_[0, np.cumsum(n)]
    codes = np.empty(first[-1], np.int64)
    codes[first[:-1]] = 256
    codes[first[1:] - 1] = 257
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    codes[inner] = [c for s in streams for c in s]
    k = np.arange(first[-1]) - np.repeat(first[:-1], n) - 1  # codes since the clear code, which is at -1
    width = np.where(k < 0, 9, _WIDTH[np.maximum(k, 0)])
    ends = np.cumsum(width)
    bits = ends[first[1:] - 1] - np.r_[0, ends[first[1:-1] - 1]]
    size = (bits + 7) // 8
    start = np.r_[0, np.cumsum(size)]
    local = ends - width - np.repeat(np.r_[0, ends[first[1:-1] - 1]], n)
    at = np.repeat(start[:-1] * 8, n) + local
    value = codes << (at & 7)
    byte = at >> 3
    out = np.zeros(start[-1] + 3, np.int64)
    for i in range(3):
        out += np.bincount(byte + i, weights=value >> (8 * i) & 255, minlength=len(out)).astype(np.int64)[: len(out)]
    data = out.astype(np.uint8).tobytes()
    return [data[a:b] for a, b in zip(start, start[1:])]


def _blocks(data: bytes) -> bytes:
    parts = []
    for i in range(0, len(data), 255):
        piece = data[i : i + 255]
        parts += (bytes((len(piece),)), piece)
    return b"".join(parts) + b"\0"


def encode(samples: bytes) -> bytes:
    """A GIF whose frames of SIDE by SIDE hold the samples; their length is a positive multiple of FRAME."""
    parts = [b"GIF89a", struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0), GREY, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    head = b"!\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    for lo in range(0, len(samples), FRAME * 256):
        streams = [lzw_codes(samples[i : i + FRAME]) for i in range(lo, min(len(samples), lo + FRAME * 256), FRAME)]
        for data in pack(streams):
            parts += (head, _blocks(data))
    return b"".join(parts) + b";"


def lzw_decode(data: bytes, root: int, limit: int) -> bytes:
    """Samples of an LZW stream whose root codes have ``root`` bits; at most ``limit`` of them."""
    clear, end = 1 << root, (1 << root) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, size = 8 * len(data), 0, [], 0
    # Widths depend only on how many codes have come since the last clear code.
    free = end + 1 + np.maximum(np.arange(-1, 4095), 0)
    widths = np.array([min(12, max(root + 1, int(f).bit_length())) for f in free]) if root != 8 else _WIDTH
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, last, since = list(roots), b"", 0
    while at < bits and size < limit:
        want = min(4096 if since < 4096 else 65_536, (bits - at) // (root + 1) + 1)
        width = widths[np.minimum(np.arange(since, since + want), len(widths) - 1)]
        place = at + np.cumsum(width) - width
        ok = place + width <= bits
        place, width = place[ok], width[ok]
        if not len(place):
            break
        byte = place >> 3
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((code == clear) | (code == end))
        n = int(stop[0]) if len(stop) else len(code)
        for c in code[:n].tolist():
            if not last:
                if c >= clear:
                    raise ValueError("a code without an entry")
                last = table[c]
                out.append(last)
                size += 1
                continue
            if c < len(table):
                now = table[c]
            elif c == len(table):
                now = last + last[:1]
            else:
                raise ValueError("a code without an entry")
            if len(table) < 4096:
                table.append(last + now[:1])
            out.append(now)
            size += len(now)
            last = now
        if n == len(code):
            at = int(place[-1] + width[-1])
            since += n
            continue
        at = int(place[n] + width[n])
        if code[n] == end:
            break
        table, last, since = list(roots), b"", 0
    return b"".join(out)[:limit]


def lzw_decode_all(streams: list[bytes], limits: list[int]) -> list[bytes | None]:
    """Samples of several streams with 8-bit roots at once, None where a stream isn't
    a clear code, codes of one table and an end code; lzw_decode reads those.

    In one table a code of 258 + j stands for what code j stands for and the
    first sample of what code j + 1 does. Following j down to a root code tells
    a code's length and first sample; following it again writes the samples.
    """
    size = np.array([len(s) for s in streams])
    n = np.minimum(np.searchsorted(_ENDS, size * 8, side="right"), 3838)
    first = np.r_[0, np.cumsum(n)]
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    place = _ENDS[k] - _BITS[k] + np.repeat((np.cumsum(size) - size) * 8, n)
    byte = place >> 3
    code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << _BITS[k]) - 1)
    stop = np.flatnonzero((code == 257) | (code == 256) & (k > 0))
    at = np.searchsorted(stop, first[:-1])
    end = np.r_[stop, first[-1]][np.minimum(at, len(stop))]
    good = (n > 1) & (end < first[1:])
    good[good] = (code[end[good]] == 257) & (code[first[:-1][good]] == 256)

    # From here on only the codes between clear and end code of the good streams.
    inner = (k > 0) & np.repeat(good, n) & (np.arange(first[-1]) < np.repeat(end, n))
    code, k = code[inner], k[inner] - 1
    stream = np.repeat(np.arange(len(streams)), n)[inner]
    up = np.where(code < 256, -1, np.arange(len(code)) - k + code - 258)
    bad = (code >= 258) & (code - 258 >= k)
    if bad.any():
        raise ValueError("a code without an entry")
    long, root = np.ones(len(code), np.int64), np.arange(len(code))
    walk = np.flatnonzero(up >= 0)
    here = up[walk]
    while len(walk):
        long[walk] += 1
        root[walk] = here
        here = up[here]
        more = here >= 0
        walk, here = walk[more], here[more]
    lead = code[root].astype(np.uint8)
    after = np.cumsum(long)
    out = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    start = after - long
    out[start] = lead
    walk = np.flatnonzero(up >= 0)
    here = walk
    while len(walk):
        out[start[walk] + long[here] - 1] = lead[up[here] + 1]
        here = up[here]
        more = up[here] >= 0
        walk, here = walk[more], here[more]
    total = np.bincount(stream, weights=long, minlength=len(streams)).astype(np.int64)
    data, ends = out.tobytes(), np.cumsum(total)
    return [data[e - t : e][:m] if g else None for g, e, t, m in zip(good, ends, total, limits)]


@dataclass
class Frame:
    """One image of a file: where it is drawn, its palette indices, and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: bytes
    delay: int = 0
    disposal: int = 0
    transparent: int = -1


@dataclass
class Media:
    width: int
    height: int
    background: int
    palette: bytes
    frames: list[Frame] = field(default_factory=list)

    def samples(self) -> bytes:
        return b"".join(f.indices for f in self.frames)

    def shown(self) -> Iterator[tuple[int, np.ndarray]]:
        """(start in hundredths of a second, canvas of RGBA) of each frame as it is seen."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        now = 0
        for f in self.frames:
            before = canvas.copy() if f.disposal == 3 else None
            box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            index = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)[: box.shape[0], : box.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(f.palette) // 3, :3] = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
            colours[:, 3] = 255
            seen = index != f.transparent
            box[seen] = colours[index[seen]]
            yield now, canvas.copy()
            now += f.delay
            if f.disposal == 2:
                box[:] = 0
            elif before is not None:
                canvas = before


def decode(data: bytes) -> Media:
    """Reads a GIF; raises ValueError if it is none or is cut off."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF is cut off") from e


def _decode(data: bytes) -> Media:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, b""
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = data[at : at + n], at + n
    media = Media(width, height, background, palette)
    shown: dict[str, int] = {}
    waiting: list[tuple[Frame, bytes, int, bool]] = []

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9:
                bits, delay, clear = struct.unpack_from("<BHB", body)
                shown = {"delay": delay, "disposal": bits >> 2 & 7, "transparent": clear if bits & 1 else -1}
        elif kind == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if bits & 0x80:
                n = 3 << (bits & 7) + 1
                own, at = data[at : at + n], at + n
            root = data[at]
            at += 1
            media.frames.append(Frame(left, top, w, h, b"", own, **shown))
            waiting.append((media.frames[-1], blocks(), root, bool(bits & 0x40)))
            shown = {}
            if len(waiting) == 256:
                _fill(waiting)
        else:
            raise ValueError("an unknown block")
    _fill(waiting)
    return media


def _fill(waiting: list[tuple[Frame, bytes, int, bool]]) -> None:
    """Decodes the frames' code streams."""
    plain = [i for i, w in enumerate(waiting) if w[2] == 8]
    size = [f.width * f.height for f, *_ in waiting]
    quick = dict(zip(plain, lzw_decode_all([waiting[i][1] for i in plain], [size[i] for i in plain]))) if plain else {}
    for i, (frame, data, root, interlaced) in enumerate(waiting):
        index = quick.get(i)
        if index is None:
            index = lzw_decode(data, root, size[i])
        if len(index) < size[i]:
            raise ValueError("an image is cut off")
        if interlaced:  # four passes: every 8th row from 0, from 4, every 4th from 2, every 2nd from 1
            h = frame.height
            order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, s)]
            lines = np.empty((h, frame.width), np.uint8)
            lines[order] = np.frombuffer(index, np.uint8).reshape(h, frame.width)
            index = lines.tobytes()
        frame.indices = index
    waiting.clear()


def _cell(rgb: np.ndarray) -> np.ndarray:
    """The colour cell, of LEVELS ranges of each of red, green and blue."""
    level = rgb.astype(np.int64) * LEVELS // 256
    return (level[..., 0] * LEVELS + level[..., 1]) * LEVELS + level[..., 2]


def histograms(media: Media) -> tuple[np.ndarray, np.ndarray]:
    """Colour cells that occur, ascending, and for each frame, as it is shown, its pixels in each of them.

    Pixels on which nothing has been drawn don't count. Frames that cover the
    whole canvas with one palette show nothing but themselves.
    """
    frames = media.frames
    if not frames:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    place = {(f.left, f.top, f.width, f.height, f.transparent, f.palette) for f in frames}
    if len(place) == 1 and place.pop()[:5] == (0, 0, media.width, media.height, -1):
        rgb = np.zeros((256, 3), np.uint8)
        rgb[: len(frames[0].palette) // 3] = np.frombuffer(frames[0].palette, np.uint8).reshape(-1, 3)
        cells, of = np.unique(_cell(rgb), return_inverse=True)
        n, size = len(frames), media.width * media.height
        counts = np.zeros((n, len(cells)), np.int64)
        for lo in range(0, n, 1024):
            part = np.frombuffer(b"".join(f.indices for f in frames[lo : lo + 1024]), np.uint8).reshape(-1, size)
            at = of[part] + np.arange(len(part))[:, None] * len(cells)
            counts[lo : lo + len(part)] = np.bincount(at.ravel(), minlength=len(part) * len(cells)).reshape(len(part), -1)
    else:
        whole = np.zeros((len(frames), LEVELS**3), np.int64)
        for i, (_, canvas) in enumerate(media.shown()):
            whole[i] = np.bincount(_cell(canvas[canvas[..., 3] > 0]), minlength=LEVELS**3)
        cells = np.arange(LEVELS**3)
        counts = whole
    some = counts.any(axis=0)
    return cells[some], counts[:, some]


def feature(cells: np.ndarray, counts: np.ndarray, delays: list[int]) -> str:
    """Frames, running time in hundredths of a second, and the colour histogram of all frames as cell:pixels."""
    h = ",".join(f"{c}:{n}" for c, n in zip(cells.tolist(), counts.sum(axis=0).tolist()))
    return f"frames={len(delays)};time={sum(delays)};hist={h}"


_FRAME_DDL = "start_cs: bigint, delay_cs: int, cells: array<int>, pixels: array<bigint>"
_COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    f"feature string, frames array<struct<{_FRAME_DDL}>>"
)
_STORED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _offsets(sizes: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())


def _timed(parts: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> pa.Array:
    """The frames column of some rows, from their cells, counts and delays."""
    start = [t for _, _, d in parts for t in np.cumsum([0, *d[:-1]])[: len(d)].tolist()]
    size, cells, pixels = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c, n, _ in parts:
        frame, at = np.nonzero(n)
        size.append(np.bincount(frame, minlength=len(n)))
        cells.append(c[at])
        pixels.append(n[frame, at])
    offsets = _offsets(np.concatenate(size) if size else [])
    columns = [
        pa.array(start, pa.int64()), pa.array([t for *_, d in parts for t in d], pa.int32()),
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cells), pa.int32())),
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pixels), pa.int64())),
    ]
    frames = pa.StructArray.from_arrays(columns, ["start_cs", "delay_cs", "cells", "pixels"])
    return pa.ListArray.from_arrays(_offsets([len(d) for *_, d in parts]), frames)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for lo in range(0, len(ids), 200):
            rows, parts = [], []
            for i, text in zip(ids[lo : lo + 200], as_bytes(b.column("text").slice(lo, 200))):
                whole = max(FRAME, -(-len(text) // FRAME) * FRAME)
                stored = encode(text + b"\xff" * (whole - len(text)))
                media = decode(stored)
                back = media.samples()
                parts.append((*histograms(media), [f.delay for f in media.frames]))
                rows.append(
                    (i, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
                     len(stored), hashlib.sha256(stored).hexdigest(), feature(*parts[-1]))
                )
            done, frames = batch(_STORED, *zip(*rows)), _timed(parts)
            yield pa.RecordBatch.from_arrays([*done.columns, frames], [*_STORED.names, "frames"])


def store_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores each text of documents (doc_id, text) as a GIF, reads it back, and returns doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature and frames: when each is shown, for how
    long (hundredths of a second), and its pixels in each colour cell that occurs.

    Null and empty texts are one frame of padding. A long text has more frames,
    each coded by itself. Rows may repeat; equal texts give equal values.
    """
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id long, {_COLUMNS}")


_SHOWN = pa.schema(
    [("media_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()),
     ("height", pa.int32()), ("rgba", pa.binary()), ("cells", pa.list_(pa.int32())), ("pixels", pa.list_(pa.int64())), ("error", pa.string())]
)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, data in zip(b.column("media_id").to_pylist(), b.column("data").to_pylist()):
            try:
                media = decode(data or b"")
            except ValueError as e:
                yield batch(_SHOWN, [i], *([None],) * 8, [str(e)])
                continue
            for n, (start, canvas) in enumerate(media.shown()):
                cells, pixels = np.unique(_cell(canvas[canvas[..., 3] > 0]), return_counts=True)
                delay = media.frames[n].delay
                yield batch(_SHOWN, [i], [n], [start], [delay], [media.width], [media.height], [canvas.tobytes()], [cells], [pixels], [None])


def frames(media: DataFrame) -> DataFrame:
    """Timed frames of GIFs (media_id, data) as they are shown, one row for each, with their
    colour histogram: cells and the pixels in them. What can't be read gives one row with the error."""
    return media.select("media_id", "data").mapInArrow(
        _frames,
        "media_id long, frame int, start_cs long, delay_cs int, width int, height int, rgba binary, "
        "cells array<int>, pixels array<long>, error string",
    )
