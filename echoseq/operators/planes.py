"""Alignments of sequences of few codes: every video with every other, counted 64 frames at a time.

Where a few codes make up all frames, most pairs of videos share some, so all pairs are compared and none is written or
shuffled: blocks of videos meet in tasks. Codes are numbered from 1, those within the threshold of one another alike, and bit b of
the numbers of a video's frames is its plane b. Frames disagree where a plane does, so an alignment is an XOR a plane, an OR and a popcount.
"""

from __future__ import annotations

import numpy as np

from .hamming_join import ranges

#: Most codes that are numbered, cells of a grid of frames, words compared at once, and found alignments held before the best are picked.
CODES, GRID, AT_ONCE, HELD = 1 << 12, 1 << 23, 1 << 17, 1 << 20
#: One in so many alignments left: their other words are looked up one by one.
FEW = 16


def numbers(codes: np.ndarray, t: int) -> np.ndarray | None:
    """Numbers from 1 of sorted distinct codes (uint64), equal for codes within t; None if being within t isn't transitive."""
    out = np.zeros(len(codes), np.uint16)
    for i in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= t)
        number = out[i] or out.max() + 1
        if (out[near] != (number if out[i] else 0)).any() or out[i] and np.count_nonzero(out == number) != len(near):
            return None
        out[near] = number
    return out


def tiles(size: np.ndarray) -> list[tuple[int, int]]:
    """Runs of videos sorted by size whose grids of frames have at most GRID cells, or one video."""
    out, lo = [], 0
    while lo < len(size):
        hi = lo + 1
        step = len(size) - lo
        while step:
            if hi + step <= len(size) and (hi + step - lo) * (size[hi + step - 1] + 64) <= GRID:
                hi += step
            else:
                step //= 2
        out.append((lo, hi))
        lo = hi
    return out


def planes(side: dict, lo: int, hi: int, bits: int, words: int) -> np.ndarray:
    """(bits, words, videos): the planes of videos lo to hi, zero past their ends."""
    size, first = side["size"][lo:hi], side["first"][lo:hi]
    out = np.empty((bits, words, hi - lo), np.uint64)
    step = max(1, GRID // (64 * words))
    for a in range(0, hi - lo, step):
        n = size[a : a + step]
        grid = np.zeros((len(n), 64 * words), side["codes"].dtype)
        grid[np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)] = side["codes"][ranges(first[a : a + step], n)]
        for b in range(bits):
            out[b, :, a : a + step] = np.packbits((grid >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8").T
    return out


def shifted(two: np.ndarray, s: int, words: int) -> np.ndarray:
    """The planes from frame s on."""
    w, r = divmod(s, 64)
    if not r:
        return np.ascontiguousarray(two[:, w : w + words])
    return two[:, w : w + words] >> np.uint64(r) | two[:, w + 1 : w + words + 1] << np.uint64(64 - r)


def apart(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x: the frames of words (bits, words, rows, 1) and (bits, words, 1, columns) that differ in any plane."""
    np.bitwise_xor(a[0], b[0], out=x)
    for k in range(1, len(a)):
        np.bitwise_xor(a[k], b[k], out=y)
        np.bitwise_or(x, y, out=x)
    return x


def alignments(one: dict, two: dict, i: tuple[int, int], j: tuple[int, int], bits: int, step: int, least: float):
    """(p, q, start, hits) of the alignments of videos of a tile of one in videos of a tile of two that reach a confidence, by start."""
    n, m = one["size"][i[0] : i[1]], two["size"][j[0] : j[1]]
    if m[-1] < n[0]:
        return
    words, far = int(-(-n[-1] // 64)), int(m[-1] - n[0])
    a, b = planes(one, *i, bits, words), planes(two, *j, bits, max(int(-(-m[-1] // 64)), words + far // 64) + 1)
    cuts = np.flatnonzero(np.r_[True, n[1:] != n[:-1], True])
    groups = [(int(n[lo]), lo, hi, fewest(int(n[lo]), least)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    room = max(AT_ONCE, 1)
    x, y, z = np.empty(room, np.uint64), np.empty(room, np.uint64), np.empty(room, np.uint8)
    for s in range(0, far + 1, step):
        base = int(np.searchsorted(m, n[0] + s))
        if base == len(m):
            return
        sh = shifted(b[:, :, base:], s, words)
        for length, lo, hi, need in groups:
            c0 = int(np.searchsorted(m, length + s))
            if c0 == len(m):
                break
            if need > length:
                continue
            w, may = -(-length // 64), length - need
            # Past the end of the shorter video the longer one differs from nothing, so it always counts.
            caps = may + np.minimum(m[c0:] - s, 64 * w) - length
            wide = min(len(m) - c0, room)
            tall = room // wide
            for c in range(c0, len(m), wide):
                d = min(c + wide, len(m))
                cap = caps[c - c0 : d - c0]
                for r in range(lo, hi, tall):
                    e = min(r + tall, hi)
                    found = reach(a[:, :w, r:e], sh[:, :w, c - base : d - base], w, may, cap, x, y, z)
                    if len(found[0]):
                        p, q, left = found
                        yield p + r + i[0], q + c + j[0], np.full(len(p), s), need + left


def fewest(n: int, least: float) -> int:
    """The least number of hits in n frames that is a confidence of `least` or more."""
    h = max(0, int(n * least) - 1)
    while h / n < least:
        h += 1
    return h


def reach(a, b, w: int, may: int, cap: np.ndarray, x, y, z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, hits above the fewest) where at most cap (of a column) frames differ. Before the last word at most `may` do."""
    tall, wide = a.shape[2], b.shape[2]
    size, k, total = tall * wide, 0, None
    while k < w:
        # As many words as there is room for, but looked at as soon as they may settle it.
        end = min(w, k + max(1, min(len(x) // size, may // 64 + 1)))
        shape = (end - k, tall, wide)
        held = [v[: (end - k) * size].reshape(shape) for v in (x, y, z)]
        got = np.bitwise_count(apart(a[:, k:end, :, None], b[:, k:end, None, :], *held[:2]), out=held[2])
        got = got[0] if end - k == 1 else got.sum(axis=0, dtype=np.uint8 if w <= 3 else np.int32)
        total = got if k == 0 and end == w else got.astype(np.uint8 if w <= 3 else np.int32) if total is None else np.add(total, got, out=total)
        k = end
        if k < w and 64 * k > may:
            on = (total <= may).ravel()
            if np.count_nonzero(on) * FEW <= size:
                p, q = np.divmod(np.flatnonzero(on), wide)
                left = total[p, q].astype(np.int64)
                for more in range(k, w):
                    left += np.bitwise_count(np.bitwise_or.reduce(a[:, more, p] ^ b[:, more, q], axis=0))
                on = np.flatnonzero(left <= cap[q])
                return p[on], q[on], cap[q[on]] - left[on]
    # Flat, as numpy skips what is false there.
    p, q = np.divmod(np.flatnonzero((total <= cap.astype(total.dtype)).ravel()), wide)
    return p, q, cap[q] - total[p, q]


def best(found: list, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair (p, q) the row with the most hits, ties to the first start."""
    p, q, s, hits = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((s, -hits, p * wide + q))
    pair = (p * wide + q)[order]
    on = order[np.r_[True, pair[1:] != pair[:-1]]]
    return p[on], q[on], s[on], hits[on]


def best_of_all(many: int, step: int, least: float, window: float | None):
    """A run for every pair of videos of two blocks: places of the pairs whose best alignment reaches a confidence, n, start and hits of it.

    Codes are numbers up to `many`, and many + 1 for null, which agrees with nothing. Blocks come sorted by size.
    """
    bits = int(many + 1).bit_length()

    def run(one, two):
        on = np.flatnonzero(one["d"] >= window)
        short = {"size": one["size"][on], "first": one["first"][on], "codes": np.where(one["codes"] > many, 0, one["codes"]).astype(one["codes"].dtype)}
        for i in tiles(short["size"]):
            for j in tiles(two["size"]):
                held, n = [], 0
                for x in alignments(short, two, i, j, bits, step, least):
                    held.append(x)
                    n += len(x[0])
                    if n >= HELD:
                        held = [best(held, len(two["size"]))]
                        n = len(held[0][0]) // 2
                if held:
                    p, q, start, hits = best(held, len(two["size"]))
                    yield on[p], q, short["size"][p], start, hits

    return run


def all_of_all(window: float):
    """A run for every pair of videos of two blocks that may be compared."""

    def run(one, two):
        for p in np.flatnonzero(one["d"] >= window):
            q = np.flatnonzero(two["size"] >= one["size"][p])
            none = np.zeros(len(q), np.int64)
            yield np.full(len(q), p), q, none, none, none

    return run
