"""64-bit codes: text form, Hamming distance, SimHash, sign hash and perceptual hash."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_WORDS = 32
#: Words whose bits are counted at once.
WORDS = 1 << 18


def from_hex(c: Column | str) -> Column:
    """16 hex digits to the two's-complement value of the 64 bits."""
    return F.conv(c, 16, -10).cast("bigint")


def to_hex(c: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def to_bytes(c: Column | str) -> Column:
    """16 hex digits to 8 bytes."""
    return F.unhex(c)


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def word_code(word: Column) -> Column:
    return from_hex(F.substring(F.md5(F.lower(word).cast("binary")), 1, 16))


def byte_lanes(code: Column, byte: int) -> Column:
    """The eight bits of one byte of a code, one in each byte of a 64-bit integer."""
    x = F.shiftrightunsigned(code, 8 * byte).bitwiseAND(F.lit(0xFF).cast("bigint"))
    for shift, mask in ((28, 0x0000000F0000000F), (14, 0x0003000300030003), (7, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def simhash_sums(code: Column) -> list[Column]:
    """Aggregates for SimHash of up to 255 codes: eight sums of eight counters each, and the number."""
    return [*[F.sum(byte_lanes(code, b)).alias(f"lanes{b}") for b in range(8)], F.count("*").alias("n_codes")]


def simhash_of_sums() -> Column:
    """A bit is 1 if more than half of the codes have it."""
    bits = [F.shiftleft((2 * F.shiftrightunsigned(f"lanes{k // 8}", 8 * (k % 8)).bitwiseAND(F.lit(0xFF).cast("bigint")) > F.col("n_codes")).cast("bigint"), k) for k in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def simhash_rows(words: int = FRAME_WORDS):
    """(id, frame_idx, h) of rows (id, text in lower case): the same codes from a text in one row. A word is hashed once a batch."""

    def run(batches):
        for rb in batches:
            lists = pc.ascii_split_whitespace(rb.column(1))
            size, word = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
            there = pc.greater(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)
            end, last = np.r_[0, np.cumsum(there)], np.cumsum(size)
            n = end[last] - end[last - size]
            word = word.filter(pa.array(there)).dictionary_encode()
            known = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8]) for w in word.dictionary.to_pylist()], np.uint64)
            parts = -(-n // words)
            first = np.cumsum(parts) - parts
            codes = np.zeros(parts.sum() * words, np.uint64)
            if len(codes):
                codes[np.arange(n.sum()) + np.repeat(words * first - (np.cumsum(n) - n), n)] = known[word.indices.to_numpy()]
            codes = codes.reshape(-1, words)
            frame = np.arange(len(codes)) - np.repeat(first, parts)
            full = np.minimum(words, np.repeat(n, parts) - words * frame)
            h, step = np.zeros(len(codes), np.uint64), max(1, WORDS // words)
            for lo in range(0, len(codes), step):
                part = codes[lo : lo + step]
                ones = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2, bitorder="little").sum(1, dtype=np.int32)
                more = 2 * ones.reshape(len(part), -1) > full[lo : lo + step, None]
                h[lo : lo + step] = np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(np.repeat(np.arange(rb.num_rows), parts))), pa.array(frame.astype(np.int64)), pa.array(h.view(np.int64))], ["video_id", "frame_idx", "h"])

    return run


def sign_hash(vector: Column) -> Column:
    """Most significant bit first: 1 where the component is positive. For 64 components."""
    bits = [F.shiftleft((F.get(vector, F.lit(i)) > 0).cast("bigint"), 63 - i) for i in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def dct_matrix(n: int = 32, rows: int = 8) -> np.ndarray:
    k, x = np.arange(rows)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def resize(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """Mean over a grid of size x size cells of a greyscale image."""
    h, w = grey.shape
    ys, xs = (np.arange(size + 1) * h // size), (np.arange(size + 1) * w // size)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1, x0, x1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1).clip(max=h), xs[:-1], np.maximum(xs[1:], xs[:-1] + 1).clip(max=w)
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return sums / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def phash(grey: np.ndarray) -> str:
    """DCT of the 32 x 32 image, low 8 x 8 block, bit = coefficient over the block's median, row-major."""
    d = dct_matrix()
    low = (d @ resize(grey) @ d.T).ravel().round(6)
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
