import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import gif


def test_roundtrip_of_samples():
    rng = random.Random(0)
    for frames in (1, 2, 300):
        data = bytes(rng.choices(rng.choice([b"ab", bytes(range(256)), b"x"]), k=576 * frames))
        media = gif.decode(gif.encode(data))
        assert media.samples() == data and len(media.frames) == frames
        index = np.frombuffer(data, np.uint8).astype(int).reshape(frames, 576)
        assert cells_of(media) == [dict(Counter((row // 32 * 73).tolist())) for row in index]


def slow_decode(data, root):
    """LZW one code at a time."""
    clear, end = 1 << root, (1 << root) + 1
    acc = int.from_bytes(data, "little")
    table, width, last, out, at = [], root + 1, None, b"", 0
    while True:
        code = acc >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], root + 1, None
        elif code == end:
            return out
        else:
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last is not None and len(table) < 4096:
                table.append(last + now[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = now


def slow_encode(samples, root, every=10**9):
    """LZW with a clear code whenever the table is full or after ``every`` codes."""
    clear, end = 1 << root, (1 << root) + 1
    acc = bits = 0

    def put(code):
        nonlocal acc, bits
        acc |= code << bits
        bits += width

    width, n = root + 1, 0
    put(clear)
    table, free, last = {}, end + 1, ()
    for c in samples:
        if last + (c,) in table or not last:
            last += (c,)
            continue
        put(table[last] if len(last) > 1 else last[0])
        n += 1
        if free < 4096:
            table[last + (c,)] = free
            free += 1
            if free > 1 << width and width < 12:
                width += 1
        if free == 4096 or n % every == 0:
            put(clear)
            table, free, width = {}, end + 1, root + 1
        last = (c,)
    put(table[last] if len(last) > 1 else last[0])
    if free - 1 + 1 == 1 << width and width < 12:
        width += 1
    put(end)
    return acc.to_bytes((bits + 7) // 8, "little")


def test_streams_with_clear_codes_and_other_roots():
    rng = random.Random(1)
    for root, n, every in ((8, 500, 50), (8, 30_000, 10**9), (2, 700, 90), (4, 9000, 10**9)):
        samples = bytes(rng.choices(range(min(1 << root, 20)), k=n))
        data = slow_encode(samples, root, every)
        assert slow_decode(data, root) == samples
        assert gif.lzw_decode(data, root, n) == samples
        if root == 8:
            (found,) = gif.lzw_decode_all([data], [n])
            assert found in (None, samples)


def test_our_streams_read_by_the_plain_decoder():
    rng = random.Random(2)
    parts = [bytes(rng.choices(b"the quick", k=576)) for _ in range(20)] + [b"a" * 576, bytes(range(256)) * 2 + b"z" * 64]
    for part, data in zip(parts, gif.pack([gif.lzw_codes(p) for p in parts])):
        assert slow_decode(data, 8) == part


def image(left, top, w, h, samples, *, palette=b"", interlaced=False, root=2):
    flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
    return b"," + struct.pack("<HHHHB", left, top, w, h, flags) + palette + bytes([root]) + gif._blocks(slow_encode(samples, root))


def control(disposal=0, delay=0, transparent=-1):
    return b"!\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent >= 0), delay, max(transparent, 0), 0)


RGB = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])  # black, red, green, blue


def file(*parts):
    return b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + RGB + b"".join(parts) + b";"


def test_disposal_transparency_and_palettes():
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = file(
        control(1, 5), image(0, 0, 4, 2, [1] * 8),
        control(3, 7, transparent=0), image(1, 0, 2, 2, [2, 0, 0, 2]),
        control(2, 1), image(0, 0, 1, 1, [3]),
        control(0, 2), image(3, 1, 1, 1, [1], palette=local),
    )
    shown = list(gif.decode(data).shown())
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    canvases = [[[tuple(map(int, p)) for p in row] for row in c] for _, c in shown]
    assert [t for t, _ in shown] == [0, 5, 12, 13]
    assert canvases[0] == [[red] * 4] * 2
    assert canvases[1] == [[red, green, red, red], [red, red, green, red]]
    assert canvases[2] == [[blue, red, red, red], [red] * 4]  # the second was undone
    assert canvases[3] == [[clear, red, red, red], [red, red, red, (8, 8, 8, 255)]]  # the third was cleared


def test_interlaced():
    h, rows = 19, [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, 19, s)]
    samples = [y % 4 for y in rows for _ in range(2)]
    frame = gif.decode(file(image(0, 0, 2, h, samples, interlaced=True))).frames[0]
    assert list(frame.indices) == [y % 4 for y in range(h) for _ in range(2)]


@pytest.mark.parametrize("cut", [1, 30, 80, 99])
def test_cut_off(cut):
    with pytest.raises(ValueError):
        data = gif.encode(b"abc" * 192)
        gif.decode(data[: len(data) * cut // 100])
    with pytest.raises(ValueError):
        gif.decode(b"PNG" + b"\0" * cut)


def test_query(spark, edge, none):
    texts = {r.doc_id: r.text for r in edge.select("doc_id", "text").collect()}
    got = gif.store_texts(spark, edge).collect()
    assert len(got) == edge.count()
    for r in got:
        if r.doc_id is None:
            continue
        data = (texts[r.doc_id] or "").encode()
        whole = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored = gif.encode(whole)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(whole), len(stored))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        n = len(whole) // 576
        grey = lambda x: sorted(Counter(v // 32 * 73 for v in x).items())
        assert r.feature == f"frames={n};time={n * 10};hist=" + ",".join(f"{c}:{k}" for c, k in grey(whole))
        assert [(f.start_cs, f.delay_cs) for f in r.frames] == [(10 * k, 10) for k in range(n)]
        for k in {0, n // 2, n - 1}:
            assert list(zip(r.frames[k].cells, r.frames[k].pixels)) == grey(whole[576 * k : 576 * (k + 1)])
    assert gif.store_texts(spark, none).collect() == []


def test_frames(spark):
    rows = [(1, gif.encode(b"a" * 1152)), (2, b"junk"), (3, None), (4, file(control(1, 5), image(0, 0, 4, 2, [1] * 8)))]
    got = gif.frames(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert [(r.media_id, r.frame, r.start_cs, r.delay_cs) for r in got if r.error is None] == [(1, 0, 0, 10), (1, 1, 10, 10), (4, 0, 0, 5)]
    assert sorted(r.media_id for r in got if r.error) == [2, 3]
    assert [(r.cells, r.pixels) for r in got if r.error is None] == [([ord("a") // 32 * 73], [576])] * 2 + [([7 * 64], [8])]


def cells_of(media):
    cells, counts = gif.histograms(media)
    return [{int(c): int(k) for c, k in zip(cells, row) if k} for row in counts]


def test_histograms_are_of_frames_as_shown():
    """Red and green are as bright to the eye but not of one cell; disposal and transparency count."""
    red, green, blue = 7 * 64, 7 * 8, 7
    data = file(
        control(1, 5), image(0, 0, 4, 2, [1] * 8),
        control(3, 7, transparent=0), image(1, 0, 2, 2, [2, 0, 0, 2]),
        control(2, 1), image(0, 0, 1, 1, [3]),
        control(0, 2), image(3, 1, 1, 1, [2]),
    )
    assert cells_of(gif.decode(data)) == [{red: 8}, {red: 6, green: 2}, {red: 7, blue: 1}, {red: 6, green: 1}]
    whole = [bytes(random.Random(k).choices(b"\0\1\2\3", k=8)) for k in range(5)]
    media = gif.decode(file(*(image(0, 0, 4, 2, list(w)) for w in whole)))
    colours = [0, red, green, blue]
    assert cells_of(media) == [dict(Counter(colours[v] for v in w)) for w in whole]
    media.frames[2].transparent = 9  # off the quick way, with the same pixels
    assert cells_of(media) == [dict(Counter(colours[v] for v in w)) for w in whole]
    assert cells_of(gif.decode(file())) == []
