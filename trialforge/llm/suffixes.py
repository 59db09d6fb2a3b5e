"""Suffix sorting in two stages: suffixes smaller than their successors are sorted directly, the rest follow by bucket scans."""

from __future__ import annotations

import numpy as np

#: No byte of UTF-8; stands behind pieces that are shorter than a key.
PAD = 0xFF


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. t ends in a 0 that stands nowhere else; that end counts as smaller."""
    n = len(t)
    out = np.ones(n, dtype=bool)
    step = np.flatnonzero(t[:-1] != t[1:])  # a run of equal bytes is of the type of its last
    rise = t[step] < t[step + 1]
    out[: n - 1] = np.repeat(rise, np.diff(step, prepend=-1))
    return out


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each tuple of keys (the first counts most), equal for equal ones, and how many ranks there are."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1


def sort_smaller(t: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """The places of the suffixes that are smaller than their successors, sorted by depth bytes at least.

    Such a place and the bytes up to the next one are a piece. Pieces are named by rank, eight bytes at a time; a place's
    rank is then refined by the rank so many pieces on, twice as far each time.
    """
    b = np.flatnonzero(smaller)
    length = np.diff(b, append=b[-1]) + 1
    length[-1] = 1
    padded = np.concatenate([t, np.full(16, PAD, t.dtype)])
    rank, n, at, open_ = np.zeros(len(b), dtype=np.int64), 1, 0, np.arange(len(b))
    while len(open_) and at < depth:
        word = np.zeros(len(open_), dtype=np.uint64)
        for j in range(8):
            inside = at + j < length[open_]
            word = (word << np.uint64(8)) | np.where(inside, padded[np.minimum(b[open_] + at + j, len(padded) - 1)], PAD).astype(np.uint64)
        fine, m = _ranked(rank[open_], word)
        if not at:
            rank, n = fine, m
        elif m > len(np.unique(rank[open_])):  # ranks of a few are refined: those above make room
            whole = np.zeros(len(b), dtype=np.int64)
            whole[open_] = fine
            rank, n = _ranked(rank, whole)
        at += 8
        count = np.bincount(rank, minlength=n)
        open_ = open_[(length[open_] > at) & (count[rank[open_]] > 1)]
    pieces = 1
    while pieces < depth and n < len(b):
        after = np.full(len(b), -1, dtype=np.int64)
        after[:-pieces] = rank[pieces:]
        rank, n = _ranked(rank * np.int64(len(b) + 1) + after + 1)
        pieces *= 2
    return b[np.argsort(rank, kind="stable")]  # ties by place, so that equal stretches keep their order from place to place


def suffix_array(data: bytes | np.ndarray, depth: int) -> np.ndarray:
    """Places of data in the order of their suffixes, right for the first depth bytes at least; data is UTF-8 or parts of it."""
    raw = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes | bytearray | memoryview) else data
    t = np.empty(len(raw) + 1, dtype=np.uint8)
    np.add(raw, 1, out=t[:-1])
    t[-1] = 0
    smaller = types(t)
    direct = sort_smaller(t, smaller, depth)
    ends = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        front, bucket = np.concatenate(waiting[c]) if waiting[c] else direct[:0], []
        waiting[c] = []
        while len(front):  # larger suffixes of this byte, then those that follow from them within the bucket
            bucket.append(front)
            front = front[front > 0] - 1
            front = front[t[front] == c]
        bucket.append(direct[ends[c] : ends[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        heads = t[before]
        above = heads > c
        before, heads = before[above], heads[above]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cut = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cut) if len(before) else []:
            waiting[t[part[0]]].append(part)
    return np.concatenate(out)[1:]  # without the end mark


def common_prefix_reaches(data: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, block: int = 1 << 20) -> np.ndarray:
    """For pairs of places of data with depth bytes behind each: whether their suffixes share the first depth bytes.

    A few bytes rule most others out. Pairs that lie next to each other on both sides are then compared in one go, so a
    shared run is read once, about block bytes at a time.
    """
    left, right = left.astype(np.int64), right.astype(np.int64)
    alive = np.arange(len(left))
    for at in sorted({(depth - 1) * i // 16 for i in range(17)}, reverse=True):
        alive = alive[data[left[alive] + at] == data[right[alive] + at]]
    found = np.zeros(len(left), dtype=bool)
    if not len(alive):
        return found
    alive = alive[np.argsort(left[alive], kind="stable")]
    a, b = left[alive], right[alive]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=len(a)) + depth - 1  # bytes of each run of pairs
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(block, int(sizes.sum()) + block, block)) + 1
    for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        part, size = starts[i:j], sizes[i:j]
        if not len(part):
            continue
        base = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(base, size)
        differ = data[np.repeat(a[part], size) + inner] != data[np.repeat(b[part], size) + inner]
        total = np.concatenate([[0], np.cumsum(differ)])
        pairs = np.arange(part[0], starts[j] if j < len(starts) else len(a))
        run = np.searchsorted(part, pairs, side="right") - 1
        at = base[run] + a[pairs] - a[part][run]
        found[alive[pairs]] = total[at + depth] == total[at]
    return found
