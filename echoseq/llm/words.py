"""Words, word hashes and hashes of word runs over UTF-8 buffers, vectorised with NumPy.

A word is `[^\\x20\\x09-\\x0D]+`. These separators are single bytes that never occur inside a
multi-byte character, so words are found on bytes. A word's hash takes its bytes eight at a time, each step mixed;
long words go through BLAKE2. A run's hash mixes the words' hashes in the same way, so no structure of bytes or
words (as that of polynomials modulo 2**64) makes unequal ones meet.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the murmur3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


#: Bytes up to which a word is hashed in vectorised steps.
LONG = 64
STIR, ADD = seeds(2, 17) | U64(1), seeds(2, 18)
TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [MASK], U64)


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ns = ~SPACE[data]
    st, en = ns.copy(), ns.copy()
    st[1:] &= ~ns[:-1]
    en[:-1] &= ~ns[1:]
    a = off[off < len(data)]
    st[a] = ns[a]
    b = off[off > 0] - 1
    en[b] = ns[b]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, off)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of words of every text."""
    return np.diff(spans(data, off)[2])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each word; another salt (0 or 1) gives another one."""
    size = ends - starts
    out = mix(size.astype(U64) * STIR[salt] + ADD[salt])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        x = eight[at] & TAIL[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ x) * STIR[salt] + ADD[salt])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left * STIR[0]) ^ (mix(right + ADD[0]) * STIR[1]))


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of words[start : start + length] for every start, by doubling: runs of a power of two cover it."""
    if not len(starts):
        return np.zeros(0, U64)
    size, x = 1, words
    while size * 2 <= length:
        x = joined(x[:-size], x[size:])
        size *= 2
    return mix(joined(x[starts], x[starts + length - size]) + U64(length))


def short_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of words[start : start + length] for lengths that differ; made for short runs."""
    out = mix(lengths.astype(U64) + ADD[1])
    live, k = np.flatnonzero(lengths > 0), 0
    while len(live):
        out[live] = joined(out[live], words[starts[live] + k])
        k += 1
        live = live[lengths[live] > k]
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + size - 1 for every start, one after the other."""
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
