"""Suffix arrays in numpy: Larsson-Sadakane refinement, whole or to given depths, and Kasai's common prefixes.

The text is a row of strings that end at given places; no suffix reaches beyond
the end of its string.
"""

from __future__ import annotations

import numpy as np

#: Places are numbers of this many bits, so that two groups and a place fit one word.
PLACE_BITS = 20
LONGEST = (1 << PLACE_BITS) - 2
_FIRST = 5
_START = 4
_WORD = 8
_STRIDE = 64
_STEPS = np.arange(0, _STRIDE, _WORD)


def _bytes_from(text: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as a big-endian number, zero beyond the string's end."""
    padded = np.r_[text, np.zeros(n, np.uint8)]
    out = np.zeros(len(text), np.uint64)
    for i in range(n):
        out <<= np.uint64(8)
        out |= padded[i : i + len(text)]
    missing = np.maximum(0, n - left)
    cut = np.flatnonzero(missing)
    shift = (8 * np.minimum(missing[cut], n)).astype(np.uint64)
    out[cut] = np.where(missing[cut] >= n, np.uint64(0), out[cut] >> shift << shift)
    return out


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, equal ones in the order of their places.

    ``ends`` has for each place the end of its string; LONGEST bytes at most.
    Suffixes that are equal as far as is known form a group, numbered by the
    first of its ranks. Groups are refined by the group of the suffix that
    starts where the known prefix ends, so the known depth doubles; a group of
    one is done, and so are equal suffixes whose ends are reached.
    """
    n = len(text)
    if n > LONGEST:
        raise ValueError("the text is too long")
    bits, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
    places = np.arange(n, dtype=np.uint64)
    left = ends - np.arange(n)
    # Five bytes, how many of them the string has, and the place: sorted by value, place and all.
    packed = _bytes_from(text, left, _FIRST) << np.uint64(3) | np.minimum(left, _FIRST).astype(np.uint64)
    packed = packed << bits | places
    packed.sort()
    order = (packed & mask).astype(np.int64)
    group = np.empty(n, np.int64)
    todo, suffix, known = np.arange(n), order, _FIRST
    key = packed >> bits
    ended = key & np.uint64(7) < _FIRST
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(head)
        group[suffix] = todo[starts][np.cumsum(head) - 1]
        size = np.diff(np.r_[starts, len(todo)])
        todo = todo[np.repeat(size > 1, size) & ~ended]
        if not len(todo):
            return order
        suffix = order[todo]
        more = suffix + known
        alive = more < ends[suffix]
        after = np.zeros(len(todo), np.uint64)
        after[alive] = group[more[alive]] + 1
        packed = (group[suffix].astype(np.uint64) << bits | after) << bits | suffix.astype(np.uint64)
        packed.sort()
        order[todo] = suffix = (packed & mask).astype(np.int64)
        key = packed >> bits
        ended = key & mask == 0
        known *= 2


def prefix_classes(text: np.ndarray, ends: np.ndarray, depths: list[int], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """For each of ``depths``, which rise, a number for each place: that of the suffixes
    that share so many bytes with its own. It tells nothing where the string ends before that,
    and of places that aren't ``wanted`` (a mask for each depth).

    The refinement is that of ``suffix_array``, and stops when the prefixes are known: numbers are the
    first rank of a group in the suffixes' order. Those of a depth between two doublings are
    told by two prefixes that overlap.
    """
    n = len(text)
    if n > LONGEST:
        raise ValueError("the text is too long")
    begin = min(_START, depths[0])
    # The places whose groups have to be right at a depth: those that are asked for, and those that these look up.
    needed = {begin: np.zeros(n, bool)}
    while 2 * max(needed) <= depths[-1]:
        needed[2 * max(needed)] = np.zeros(n, bool)
    for depth, mask_ in zip(depths, wanted):
        base = max(k for k in needed if k <= depth)
        needed[base] |= mask_
        needed[base][depth - base :] |= mask_[: max(0, n - depth + base)]
    for k in sorted(needed)[:0:-1]:
        needed[k // 2] |= needed[k]
        needed[k // 2][k // 2 :] |= needed[k][: max(0, n - k // 2)]
    bits, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
    places = np.arange(n, dtype=np.uint64)
    left = ends - np.arange(n)
    packed = _bytes_from(text, left, begin) << np.uint64(3) | np.minimum(left, begin).astype(np.uint64)
    packed = packed << bits | places
    packed.sort()
    suffix = (packed & mask).astype(np.int32)
    ends = ends.astype(np.int32)
    # A place behind the last, for suffixes that end, has the least group.
    group, todo, known = np.zeros(n + 1, np.int32), np.arange(1, n + 1, dtype=np.int32), begin
    key = packed >> bits
    ended = key & np.uint64(7) < begin
    out = []

    def after(more: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return group[np.where(more < ends[suffix], more, n)].astype(np.uint64)

    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(head)
        size = np.diff(np.r_[starts, len(key)])
        if len(key):
            group[suffix] = np.repeat(todo[starts], size)
        keep = np.repeat(size > 1, size) & ~ended if len(key) else np.zeros(0, bool)
        todo, suffix = todo[keep], suffix[keep]
        while len(out) < len(depths) and depths[len(out)] < 2 * known:
            depth = depths[len(out)]
            if depth == known:
                out.append(group[:n].copy())
                continue
            use = wanted[len(out)][suffix]
            some, ranks = suffix[use], todo[use]
            both = (group[some].astype(np.uint64) << bits | after(some + (depth - known), some)) << bits | some.astype(np.uint64)
            both.sort()
            pair, found = both >> bits, group[:n].copy()
            if len(pair):
                starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                found[(both & mask).astype(np.int32)] = np.repeat(ranks[starts], np.diff(np.r_[starts, len(pair)]))
            out.append(found)
        if len(out) == len(depths):
            return out
        use = needed[2 * known][suffix]
        todo, suffix = todo[use], suffix[use]
        packed = (group[suffix].astype(np.uint64) << bits | after(suffix + known, suffix)) << bits | suffix.astype(np.uint64)
        packed.sort()
        suffix = (packed & mask).astype(np.int32)
        key = packed >> bits
        ended = key & mask == 0
        known *= 2


def common_prefixes(text: np.ndarray, first: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each rank the bytes, ``most`` at most, that its suffix shares with the one before it.

    By Kasai: from a place to the next of its string the number falls by one at
    most, so the comparison goes on from there. All strings, which start at
    ``first``, are walked side by side.
    """
    n = len(text)
    word = np.r_[_bytes_from(text, ends - np.arange(n), _WORD), np.zeros(_STRIDE, np.uint64)]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int64)
    lane_end = ends[first]
    longest = int((lane_end - first).max())
    shared = np.zeros(len(first), np.int64)
    lanes = np.argsort(first - lane_end, kind="stable")  # long strings first, so that those left are a prefix
    first, lane_end = first[lanes], lane_end[lanes]
    length = lane_end - first
    for column in range(longest):
        live = int(np.searchsorted(-length, -column, side="left"))
        here = first[:live] + column
        other = before[here]
        k = np.maximum(shared[:live] - 1, 0)
        k[other < 0] = 0
        limit = np.minimum(np.minimum(lane_end[:live] - here, ends[other] - other), most)
        limit[other < 0] = 0
        going = np.flatnonzero(k < limit)
        ahead = 1  # words that are compared at once; few lanes get beyond the first
        while len(going):
            a, b = here[going] + k[going], other[going] + k[going]
            differ = word[a[:, None] + _STEPS[:ahead]] ^ word[b[:, None] + _STEPS[:ahead]]
            at = (differ != 0).argmax(axis=1)
            first_differ = differ[np.arange(len(going)), at]
            same = np.where(first_differ == 0, ahead * _WORD, at * _WORD + (_leading(first_differ) >> 3))
            k[going] = np.minimum(k[going] + same, limit[going])
            going = going[(first_differ == 0) & (k[going] < limit[going])]
            ahead = len(_STEPS)
        shared[:live] = k
        out[rank[here]] = k
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of numbers that aren't zero."""
    high = (x >> np.uint64(32)).astype(np.uint32)
    part = np.where(high > 0, high, x.astype(np.uint32)).astype(np.float64)
    # frexp's exponent is the position of the highest bit; 32 bits are exact in a double.
    return np.where(high > 0, 32, 64) - np.frexp(part)[1]


def locate(text: np.ndarray, ends: np.ndarray, order: np.ndarray, pattern: bytes) -> tuple[int, int]:
    """The ranks whose suffixes start with pattern, as a half-open range, by binary search."""

    def bound(above: bool) -> int:
        lo, hi = 0, len(order)
        while lo < hi:
            mid = (lo + hi) // 2
            s = int(order[mid])
            piece = text[s : min(s + len(pattern), int(ends[s]))].tobytes()
            if piece < pattern or above and piece == pattern:
                lo = mid + 1
            else:
                hi = mid
        return lo

    return bound(False), bound(True)
