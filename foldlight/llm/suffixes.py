"""Anchors, windows and the two-stage suffix sort behind operator 3 (see repeats.py)."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 14)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of `gram` bytes that depends on its bytes only."""
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


#: Bytes of a text that are anchored at once; longer texts go on in overlapping pieces.
PIECE = 1 << 20
_OFFSET_BITS = np.uint64(21)


def anchored_windows(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of start positions of `length`-byte strings that share an anchor: (first, last, place, anchor hash, content hash).

    A string's anchor is its run of `gram` bytes with the smallest hash, the leftmost of equal ones: equal
    strings have equal anchors at equal places. place is the anchor's from first. The content hash covers all
    bytes of the run's strings.
    """
    firsts, lasts, places, hashes = [], [], [], []
    span = length - gram + 1
    for at in range(0, len(data) - length + 1, PIECE):
        text = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        grams = gram_hashes(text, gram)
        tagged = (grams >> _OFFSET_BITS << _OFFSET_BITS) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_minimum(tagged, span) & np.uint64((1 << 21) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        firsts.append(starts + at)
        lasts.append(np.concatenate((starts[1:], [len(anchor)])) - 1 + at)
        places.append(anchor[starts] - starts)
        hashes.append(grams[anchor[starts]])
    if not firsts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    first, last, place, anchors = map(np.concatenate, (firsts, lasts, places, hashes))
    digest = xxhash.xxh3_64_intdigest
    contents = np.fromiter((digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    return first, last, place, anchors, contents


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its successor; the last one, of the end mark, is."""
    differs = np.flatnonzero(text[:-1] != text[1:])
    at = np.searchsorted(differs, np.arange(len(text)))
    out = np.ones(len(text), bool)
    inside = at < len(differs)
    turn = differs[at[inside]]
    out[inside] = text[turn] < text[turn + 1]
    return out


def dense_rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def sort_smaller(text: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes smaller than their successors, sorted directly by at least `depth` bytes.

    Each is named by its bytes up to the next such position, kinds included, which makes no name a prefix of
    another; names of doubling spans of positions then give the order.
    """
    at = np.flatnonzero(smaller)
    symbol = np.concatenate(((text.astype(np.uint64) * np.uint64(2) + smaller) + np.uint64(1), np.zeros(8, np.uint64)))
    size = np.diff(at, append=at[-1]) + 1  # bytes of a name, its end included
    size[-1] = 1
    words = []
    for low in range(0, int(size.max()), 6):
        word = np.zeros(len(at), np.uint64)
        some = np.flatnonzero(size > low)
        part = np.zeros(len(some), np.uint64)
        for i in range(low, low + 6):
            part = (part << np.uint64(10)) | np.where(size[some] > i, symbol[np.minimum(at[some] + i, len(text))], np.uint64(0))
        word[some] = part
        words.append(word)
    rank = dense_rank(words[0])
    for word in words[1:]:
        if not word.any():
            continue
        rank = dense_rank((rank.astype(np.uint64) << np.uint64(32)) | dense_rank(word).astype(np.uint64))
    span = 1
    while rank.max() + 1 < len(rank) and span < len(at) and (at[span:] - at[:-span]).min() < depth:
        after = np.zeros(len(rank), np.uint64)
        after[:-span] = rank[span:] + 1
        rank = dense_rank((rank.astype(np.uint64) << np.uint64(32)) | after)
        span *= 2
    return at[np.argsort(rank, kind="stable")]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a text that ends with byte 0, sorted by at least `depth` bytes: two-stage sorting.

    First the suffixes smaller than their successors are sorted directly. Then the buckets of first bytes are
    scanned upwards: each suffix met in order puts its predecessor, where that one is larger than it, next in
    the predecessor's bucket.
    """
    smaller = smaller_than_next(text)
    direct = sort_smaller(text, smaller, depth)
    firsts = text[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in np.unique(text).tolist():
        larger, new = waiting[byte], np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(new):  # runs of one byte: the bucket's larger part grows by its own predecessors
            new = new[new > 0] - 1
            new = new[text[new] == byte]
            larger.append(new)
        bucket = np.concatenate([*larger, direct[bounds[byte] : bounds[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        if len(before):
            kinds = text[before]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                waiting[kinds[s]].append(before[s:e])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Lengths, up to `length`, of the common prefixes of the suffixes at a and at b."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for at in range(0, length, 16):
        step = min(16, length - at)
        offsets = at + np.arange(step)
        same = text[a[alive, None] + offsets] == text[b[alive, None] + offsets]
        whole = same.all(axis=1)
        out[alive] += np.where(whole, step, same.argmin(axis=1))
        alive = alive[whole]
        if not len(alive):
            break
    return out


def longest_shared(contexts: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """For each byte string, the longest prefix that it shares with another one of its group."""
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    rows = np.zeros((n, width + 4), ">u2")
    rows[:, :4] = np.stack([(group >> shift) & 0xFFFF for shift in (48, 32, 16, 0)], axis=1)
    inside = np.arange(width) < sizes[:, None]
    rows[:, 4:][inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    order = np.argsort(rows.view(f"S{2 * (width + 4)}").ravel(), kind="stable")
    above, below = rows[order[:-1]], rows[order[1:]]
    same = above == below
    shared = np.where(same.all(axis=1), width, same.argmin(axis=1) - 4)
    shared = np.where((group[order[:-1]] == group[order[1:]]), np.minimum(shared, np.minimum(sizes[order[:-1]], sizes[order[1:]])), 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, order[:-1], shared)
    np.maximum.at(out, order[1:], shared)
    return out


def repeated_starts(windows: list[bytes], places: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window (different contents; group: its anchor), the starts of `length`-byte strings that also
    start in another window of the group.

    A string can only repeat if what lies left and right of its anchor does so in some window: this leaves
    the part of each window that goes into the suffix array.
    """
    n = len(windows)
    sizes = np.fromiter(map(len, windows), np.int64, n)
    left = longest_shared([w[p - 1 :: -1] if p else b"" for w, p in zip(windows, places.tolist(), strict=True)], group, length)
    right = longest_shared([w[p : p + length] for w, p in zip(windows, places.tolist(), strict=True)], group, length)
    low = np.maximum(0, places - left)
    high = np.minimum(sizes - length, places - (length - right))
    some = np.flatnonzero(low <= high)
    out = [np.empty(0, np.int64)] * n
    if len(some) < 2:
        return out
    parts = [windows[i][low[i] : high[i] + length] for i in some]
    text = np.frombuffer(b"\0".join(parts) + b"\0" * (length + 1), np.uint8)
    part_sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(part_sizes + 1) - part_sizes - 1
    owner = np.repeat(np.arange(len(parts)), part_sizes + 1)
    order = suffix_order(text[: len(owner) + 1], length)
    order = order[order < len(owner)]
    order = order[order - starts[owner[order]] <= part_sizes[owner[order]] - length]
    equal = common_prefixes(text, order[:-1], order[1:], length) == length
    hit = np.zeros(len(order), bool)
    hit[:-1] |= equal
    hit[1:] |= equal
    found = np.sort(order[hit])
    of = owner[found]
    for i in np.unique(of):
        out[some[i]] = found[of == i] - starts[i] + low[some[i]]
    return out
