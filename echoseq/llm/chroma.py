"""Chroma audio fingerprints, and classes of recordings that align.

Audio (PCM of 8 to 32 bits as RIFF WAV, at any rate and number of channels, or bare unsigned 8-bit mono) is cut into
windowed frames; each spectrum is folded into twelve pitch classes, smoothed over time and normalised. On the
integral image of pitch class by time, sixteen filters (one, two or three rectangles against each other) give log
ratios, each quantised to two Gray-coded bits: one packed 32-bit integer per position.

Two recordings align at the offset that most pairs of equal integers vote for; over the overlap the bit error rate
is counted. A link needs an overlap of 0.8 or more of the longer recording and a bit error rate of 0.15 or less.

Links are found in two steps. First of pairs that vote together for an offset with that overlap by a landmark: the bits of the eight filters
whose values are spread most evenly, at three places a fixed distance apart (see `GAPS`). One integer alone is
shared by one pair of recordings in seventy by chance, so pairs that share any would grow with the square of the recordings;
a landmark hardly ever is. Then all pairs of recordings in different components that share any integer at such an offset are tried, in
blocks of recordings of like length, so no link is lost; this work grows with the square of the recordings, what is shipped does not grow so. Of a long recording those
landmarks count whose hash is under MOST over its length: two recordings of a link keep the same ones. Equal
fingerprints are one node, recordings that links already join are not compared again, and a landmark that very many
recordings hold is dealt over tasks.

Bytes that begin like WAV but can't be read as such are bare samples; other rates are resampled. Audio shorter than a
filter has no integers; it shares a class with recordings of the same samples only. Null or empty audio has no class but
its own. Long recordings are framed in steps, whole. Ties between offsets go to the least one. Rows that share an
id are one recording; a null id takes no part in links. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components, grown_components
from . import words as w
from .common import Scratch
from .linking import BLOCK, accepted
from .minhash import classes

RATE, FRAME, HOP = 11025, 256, 32
#: A WAV header with a lower rate is no recording.
LEAST_RATE = 1000
LOW_HZ, HIGH_HZ = 60.0, 3520.0
STEP_SAMPLES = 1 << 19
OVERLAP, ERRORS = 0.8, 0.15
#: Equal integers of two recordings whose offsets are counted in one step; one integer with more of them is correlated.
VOTES = 1 << 20
WIDTH = 16
#: (least, most length, distance) of the three places of a landmark in recordings of that length. Lengths overlap as far as
#: two recordings of one link may differ, so both post at a common distance.
GAPS = ((1, 2, 0), (3, 9, 1), (8, 79, 2), (64, 1 << 62, 12))
#: Landmarks of a long recording, on average.
MOST = 512
#: Filters whose bits make landmarks.
MARKS = (2, 3, 5, 7, 8, 9, 14, 15)
MARK_BITS = np.uint32(sum(3 << (30 - 2 * f) for f in MARKS))
#: Integers whose landmarks are made at once.
STEP_CODES = 1 << 18
#: Rounds at most, and comparisons a landmark's row at which the exact rest begins.
ROUNDS, LIGHT = 4, 16
#: Bytes of integers of a block of recordings in the exact rest.
REST = 1 << 22
#: Frames whose spectra are taken at once.
FRAMES = 4096
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def filter_bank(n: int = 16) -> list[tuple[int, int, int, int, float]]:
    """(kind, pitch class, height, width, quantiser step) of each filter, spread by rule over kinds, places and sizes."""
    return [(i % 6, (5 * i) % 9, 3 + (i // 6), (4, 8, 12, 16)[i % 4], 0.04 + 0.02 * (i % 3)) for i in range(n)]


FILTERS = filter_bank()


def wav_samples(audio: bytes) -> np.ndarray | None:
    """Mono samples in -1 to 1 at RATE of a PCM WAV file; None of what is no such file. A cut file gives what is there."""
    try:
        with wave.open(io.BytesIO(audio)) as f:
            raw, size, channels, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels(), f.getframerate()
    except (wave.Error, EOFError, ValueError, struct.error, OverflowError):
        return None
    if not 1 <= size <= 4 or channels < 1 or rate < LEAST_RATE:
        return None
    raw = raw[: len(raw) - len(raw) % (size * channels)]
    if size == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    else:
        # Little-endian integers of 2 to 4 bytes as the upper bytes of 32-bit ones.
        wide = np.zeros((len(raw) // size, 4), np.uint8)
        wide[:, 4 - size :] = np.frombuffer(raw, np.uint8).reshape(-1, size)
        x = wide.view("<i4")[:, 0].astype(np.float32) / (1 << 31)
    return resample(x.reshape(-1, channels).mean(1), rate)


def resample(x: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE: means over the time of each new sample."""
    if rate == RATE or not len(x):
        return x
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    edges = np.arange(len(x) * RATE // rate + 1) * (rate / RATE)
    return (np.diff(np.interp(edges, np.arange(len(total)), total)) * (RATE / rate)).astype(np.float32)


def decode(audio: bytes | None) -> np.ndarray:
    """Samples in -1 to 1 of WAV or, if it isn't that, of bare unsigned 8-bit PCM. Any bytes give samples."""
    if not audio:
        return np.zeros(0, np.float32)
    if audio[:4] == b"RIFF" and audio[8:12] == b"WAVE" and (x := wav_samples(audio)) is not None:
        return x
    return np.frombuffer(audio, np.uint8).astype(np.float32) / 128 - 1


def pitch_classes(frame: int = FRAME, rate: int = RATE) -> np.ndarray:
    """Spectrum bin to pitch class, A is 0."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    out = np.zeros((len(hz), 12), np.float32)
    ok = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[ok, np.round(12 * np.log2(hz[ok] / 27.5)).astype(int) % 12] = 1
    return out


def chroma(x: np.ndarray, starts: np.ndarray, frame: int = FRAME, rate: int = RATE) -> np.ndarray:
    """Energy by pitch class of the frames of x at `starts`."""
    if not len(starts):
        return np.zeros((0, 12), np.float32)
    at, window, fold = np.lib.stride_tricks.sliding_window_view(x, frame), np.hanning(frame).astype(np.float32), pitch_classes(frame, rate)
    out = np.empty((len(starts), 12), np.float32)
    for lo in range(0, len(starts), FRAMES):
        spectrum = np.fft.rfft(at[starts[lo : lo + FRAMES]] * window, axis=1)
        out[lo : lo + FRAMES] = (spectrum.real**2 + spectrum.imag**2) @ fold
    return out


def rectangle(total: np.ndarray, t: np.ndarray, a: int, b: int, y0: int, y1: int) -> np.ndarray:
    """Sum of the image over frames t + a to t + b and pitch classes y0 to y1."""
    return total[t + b, y1] - total[t + a, y1] - total[t + b, y0] + total[t + a, y0]


def respond(total: np.ndarray, t: np.ndarray, kind: int, y: int, h: int, wd: int) -> np.ndarray:
    """Log ratio of what a filter adds to what it takes away at positions t."""
    r = lambda a, b, c, d: rectangle(total, t, a, b, y + c, y + d)
    half, mid, third = h // 2, wd // 2, wd // 3
    if kind == 0:
        plus, minus = r(0, wd, 0, h), 0.0 * t
    elif kind == 1:
        plus, minus = r(0, wd, half, h), r(0, wd, 0, half)
    elif kind == 2:
        plus, minus = r(mid, wd, 0, h), r(0, mid, 0, h)
    elif kind == 3:
        plus, minus = r(0, mid, half, h) + r(mid, wd, 0, half), r(0, mid, 0, half) + r(mid, wd, half, h)
    elif kind == 4:
        plus, minus = r(0, wd, h // 3, h - h // 3), r(0, wd, 0, h // 3) + r(0, wd, h - h // 3, h)
    else:
        plus, minus = r(third, wd - third, 0, h), r(0, third, 0, h) + r(wd - third, wd, 0, h)
    return np.log((1 + np.maximum(plus, 0)) / (1 + np.maximum(minus, 0)))


GRAY = np.array([0, 1, 3, 2], np.uint32)


def integers(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of every recording, one after the other, and their numbers. first: each one's first frame."""
    n = np.diff(first)
    per = np.maximum(n - len(SMOOTH) + 1, 0)
    at = w.ranges(first[:-1], per)
    smooth = sum(c * features[at + k] for k, c in enumerate(SMOOTH)) if len(at) else features[:0]
    smooth = smooth / np.maximum(np.sqrt((smooth**2).sum(1, keepdims=True)), 1e-6)
    total = np.zeros((len(smooth) + 1, 13))
    total[1:, 1:] = np.cumsum(np.cumsum(smooth, axis=0, dtype=np.float64), axis=1)
    count = np.maximum(per - WIDTH + 1, 0)
    begin = np.cumsum(per) - per
    t = w.ranges(begin, count)
    code = np.zeros(len(t), np.uint32)
    for kind, y, h, wd, step in FILTERS:
        v = respond(total, t, kind, y, h, wd)
        if kind == 0:
            v = v - np.log1p(h * wd * 0.25)
        code = code << np.uint32(2) | GRAY[np.digitize(v, (-step, 0.0, step))]
    return code, count


def fingerprint_rows(batches, frame: int = FRAME, hop: int = HOP, rate: int = RATE):
    """(ids, codes, counts, samples) for steps of rows of about STEP_SAMPLES samples."""
    for rb in batches:
        ids, held, size, lo = rb.column(0), [], 0, 0
        for i, a in enumerate(rb.column(1)):
            x = decode(a.as_py())
            held.append(x)
            size += len(x)
            if size >= STEP_SAMPLES or i == rb.num_rows - 1:
                n = np.array([len(x) for x in held])
                frames = np.maximum((n - frame) // hop + 1, 0)
                begin = np.cumsum(n) - n
                starts = np.repeat(begin, frames) + hop * w.ranges(np.zeros(len(n), np.int64), frames)
                yield ids.slice(lo, i + 1 - lo), *integers(chroma(np.concatenate(held), starts, frame, rate), np.concatenate([[0], np.cumsum(frames)])), held
                held, size, lo = [], 0, i + 1


SIGNED = "doc_id long, n_codes long, n_distinct long, digest binary, codes binary"


def samples_digest(x: np.ndarray) -> bytes | None:
    """Digest of audio too short for an integer; None of empty audio."""
    return hashlib.blake2b(x.tobytes(), digest_size=16, person=b"samples").digest() if len(x) else None


def signatures(batches):
    for ids, codes, count, held in fingerprint_rows(batches):
        sets = [len(np.unique(x)) for x in np.split(codes, np.cumsum(count)[:-1])] if len(count) else []
        # Equal sets are no equal recordings: the digest is that of the integers in order.
        raw, ends = codes.tobytes(), 4 * np.cumsum(count)
        own = [raw[e - 4 * c : e] for c, e in zip(count.tolist(), ends.tolist(), strict=True)]
        digest = [hashlib.blake2b(x, digest_size=16).digest() if x else samples_digest(h) for x, h in zip(own, held, strict=True)]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(count, pa.int64()), pa.array(sets, pa.int64()), pa.array(digest, pa.binary()), pa.array(own, pa.binary())], ["doc_id", "n_codes", "n_distinct", "digest", "codes"])


def landmarks(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, recording number) of every landmark of recordings with `size` integers each, one after the other."""
    row, at, begin = np.repeat(np.arange(len(size)), size), w.ranges(np.zeros(len(size), np.int64), size), np.cumsum(size) - size
    marks, out = (codes & MARK_BITS).astype(np.uint64), []
    with np.errstate(over="ignore"):
        under = np.minimum(MOST / np.maximum(size, 1) * 2.0**64, 2.0**64 - 4096).astype(np.uint64)
        under[size <= MOST] = w.U64(w.MASK)
    for least, most, gap in GAPS:
        ok = np.flatnonzero((size[row] >= least) & (size[row] <= most) & (at + 2 * gap < size[row]))
        key = np.full(len(ok), gap + 1, np.uint64)
        for k in range(3):
            key = w.mix(key * w.STIR[0] + marks[begin[row[ok]] + at[ok] + k * gap])
        few = key <= under[row[ok]]
        out.append((key[few], at[ok][few], row[ok][few]))
    key, at, row = (np.concatenate(x) for x in zip(*out, strict=True))
    return key, at, row


def posting_steps(batches):
    """(ids, lengths, key, position, recording) for steps of recordings of about STEP_CODES integers."""
    for rb in batches:
        ids, own = rb.column(0).to_numpy(zero_copy_only=False), [np.frombuffer(x, np.uint32) for x in rb.column(1).to_pylist()]
        size = np.array([len(x) for x in own], np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // STEP_CODES, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(own)], strict=True):
            if size[lo:hi].sum():
                yield ids[lo:hi], size[lo:hi], *landmarks(np.concatenate(own[lo:hi]), size[lo:hi])


def marks(batches):
    """(key): every landmark of a recording, once."""
    for _, size, key, _, row in posting_steps(batches):
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64))], ["key"])


def postings(batches):
    """(key, id, size, lo, hi): every landmark of a recording with its first and last position."""
    for ids, size, key, at, row in posting_steps(batches):
        order = np.lexsort((at, key, row))
        key, at, row = key[order], at[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(key)]])[: len(new)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[row[new]], pa.int64()), pa.array(size[row[new]].astype(np.int32)), pa.array(at[new].astype(np.int32)), pa.array(at[last].astype(np.int32))], ["key", "id", "size", "lo", "hi"])


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of equal integers at each offset of a in b, from 1 - len(a) on."""
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    value, fa, na = np.unique(a[oa], return_index=True, return_counts=True)
    lo, hi = np.searchsorted(b[ob], value, "left"), np.searchsorted(b[ob], value, "right")
    met = na * (hi - lo)
    # An integer that fills both recordings, as silence does, votes by correlation of its places.
    for k in np.flatnonzero(met > VOTES).tolist():
        x, y = np.zeros(1 << (len(votes) - 1).bit_length()), np.zeros(1 << (len(votes) - 1).bit_length())
        x[len(a) - 1 - oa[fa[k] : fa[k] + na[k]]] = 1
        y[ob[lo[k] : hi[k]]] = 1
        votes += np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), len(x)))[: len(votes)].astype(np.int64)
    few = np.repeat(np.where(met > VOTES, 0, hi - lo), na)
    start = np.repeat(lo, na)
    done = np.cumsum(few)
    cut = [0, *np.searchsorted(done, np.arange(VOTES, int(done[-1]) if len(done) else 0, VOTES)).tolist(), len(few)]
    for s, e in zip(cut, cut[1:], strict=False):
        votes += np.bincount(ob[w.ranges(start[s:e], few[s:e])] + len(a) - 1 - np.repeat(oa[s:e], few[s:e]), minlength=len(votes))
    return votes


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(offset of a in b, positions that overlap, bit errors there). Most votes of equal integers win, ties to the least offset."""
    offset = int(np.argmax(offset_votes(a, b))) - (len(a) - 1)
    s, e = max(0, -offset), min(len(a), len(b) - offset)
    return offset, e - s, int(np.bitwise_count(a[s:e] ^ b[s + offset : e + offset]).sum())


def linked(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    most = max(len(a), len(b))
    if not most or min(len(a), len(b)) < OVERLAP * most or not np.isin(a, b).any():
        return False
    _, overlap, errors = align(a, b)
    return overlap >= OVERLAP * most and errors <= ERRORS * 32 * overlap


def errors_within(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which runs a[at : at + n] and b[to : to + n] differ in `most` bits at most. Nearly all are rejected by less than half of them."""
    ok = np.arange(len(n))
    for size in ((9 * n + 19) // 20, n):
        ok, k = ok[size[ok] > 0], size[ok][size[ok] > 0]
        keep, end = np.zeros(len(ok), bool), np.cumsum(k)
        lo = 0
        while lo < len(ok):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - k[lo] + STEP_CODES, "right")))
            x, m = ok[lo:hi], k[lo:hi]
            bits = np.bitwise_count(a[w.ranges(at[x], m)] ^ b[w.ranges(to[x], m)])
            keep[lo:hi] = np.add.reduceat(bits, np.cumsum(m) - m, dtype=np.int64) <= most[x]
            lo = hi
        ok = ok[keep]
    return ok


def block_pairs(one: tuple, two: tuple | None):
    """(la, lb): labels of recordings that link though their labels differ, of two blocks (labels, sizes, integers), or of one with itself.

    Every pair that shares an integer at an offset with the overlap is tried there: an offset that has won the votes is among them.
    """
    same, two = two is None, two or one
    (la, na, a), (lb, nb, b) = one, two
    fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    # Integers of the second block by value and label, so that a posting skips those of its own label at once.
    names, rank = np.unique(np.r_[la, lb], return_inverse=True)
    key_a = a.astype(np.uint64) << np.uint64(32) | rank[: len(la)][ra].astype(np.uint64)
    key_b = b.astype(np.uint64) << np.uint64(32) | rank[len(la) :][rb].astype(np.uint64)
    order = np.argsort(key_b)
    sorted_b = key_b[order]
    low = key_a & ~np.uint64(0xFFFFFFFF)
    lo, hi = np.searchsorted(sorted_b, low), np.searchsorted(sorted_b, low | np.uint64(0xFFFFFFFF), "right")
    mid, end = np.searchsorted(sorted_b, key_a), np.searchsorted(sorted_b, key_a, "right")
    known = set()
    for start, n in ((lo, mid - lo), (end, hi - end)):
        # One of a block's own pairs comes twice, once from either side: the greater label's is left.
        some = np.flatnonzero(n) if not (same and start is end) else np.zeros(0, np.int64)
        done = np.cumsum(n[some])
        p = 0
        while p < len(some):
            q = max(p + 1, int(np.searchsorted(done, done[p] - n[some[p]] + VOTES, "right")))
            x = np.repeat(some[p:q], n[some[p:q]])
            y = order[w.ranges(start[some[p:q]], n[some[p:q]])]
            p = q
            i, j = ra[x], rb[y]
            offset = (y - fb[j]) - (x - fa[i])
            most = np.maximum(na[i], nb[j])
            s = np.maximum(0, -offset)
            overlap = np.minimum(na[i], nb[j] - offset) - s
            ok = np.flatnonzero(overlap >= OVERLAP * most)
            if not len(ok):
                continue
            _, new = np.unique(((i * len(nb) + j) * (len(a) + len(b)) + offset + len(a))[ok], return_index=True)
            ok = ok[new]
            i, j, s, offset, overlap = i[ok], j[ok], s[ok], offset[ok], overlap[ok]
            good = errors_within(a, b, fa[i] + s, fb[j] + s + offset, overlap, ERRORS * 32 * overlap)
            for u, v in set(zip(i[good].tolist(), j[good].tolist(), strict=True)):
                link = (int(la[u]), int(lb[v]))
                if link not in known and linked(a[fa[u] : fa[u] + na[u]].tobytes(), b[fb[v] : fb[v] + nb[v]].tobytes()):
                    known.add(link)
    return known


def rest_rows(batches):
    """Links (a, b) of labels from rows (c, i, d, j, kind, label, codes) that come sorted by pair of blocks and kind."""
    key, sides = None, ([], [])

    def met():
        if sides[0] and (sides[1] or key[:2] == key[2:]):
            both = []
            for side in sides:
                size = np.array([len(x) // 4 for _, x in side], np.int64)
                both.append((np.array([label for label, _ in side], np.int64), size, np.frombuffer(b"".join(x for _, x in side), np.uint32)))
            found = sorted(block_pairs(both[0], both[1] if sides[1] else None))
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], ["a", "b"])

    for rb in batches:
        for *here, kind, label, codes in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if here != key:
                yield from met()
                key, sides = here, ([], [])
            if kind == 0 or sides[0]:
                sides[kind].append((label, codes))
    yield from met()


def rest_links(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): links between components that no landmark has found, of all pairs of recordings. Blocks of recordings of like length meet each other."""
    long = lambda x: F.lit(x).cast("long")
    size = F.octet_length("codes") / 4
    rows = nodes.where("octet_length(codes) > 0").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "codes")
    # Lengths of a link differ by a class at most; the base is a little over 1 / OVERLAP.
    rows = rows.withColumn("c", F.floor(F.log(size) / float(np.log(1.0001 / OVERLAP))).cast("long"))
    held = {r["c"]: -(-4 * r["n"] // REST) for r in rows.groupBy("c").agg(F.sum(size.cast("long")).alias("n")).collect()}
    parts = F.array(*[long(int(held.get(c, 0))) for c in range(max(held, default=0) + 2)])
    of = lambda c: F.coalesce(F.get(parts, c.cast("int")), long(0))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), of(F.col("c"))))
    c, i = F.col("c"), F.col("i")
    key = lambda a, b, d, e, kind: F.struct(a.alias("c"), b.alias("i"), d.alias("d"), e.alias("j"), F.lit(kind).alias("kind"))
    upto = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<bigint>"))
    there = F.concat(
        F.transform(upto(i, of(c)), lambda j: key(c, i, c, j, 0)), F.transform(upto(long(0), of(c + 1)), lambda j: key(c, i, c + 1, j, 0)),
        F.transform(upto(long(0), i), lambda j: key(c, j, c, i, 1)), F.transform(upto(long(0), F.when(c > 0, of(c - 1)).otherwise(long(0))), lambda j: key(c - 1, j, c, i, 1)),
    )
    rows = rows.select(F.explode(there).alias("k"), "label", "codes").select("k.*", "label", "codes")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "c", "i", "d", "j").sortWithinPartitions("c", "i", "d", "j", "kind")
    return rows.mapInArrow(rest_rows, "a long, b long")


#: Whether an offset of x in the other recording at which this landmark votes may have the overlap.
MEETS = f"id <> x and hi - lx >= {OVERLAP} * greatest(size, sx) - sx and lo - hx <= size - {OVERLAP} * greatest(size, sx)"


def link_recordings(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every recording of `nodes` (id, codes) that has a link: by landmarks first, then the exact rest."""
    labels = landmark_links(nodes, scratch)
    return grown_components(labels, scratch.table(rest_links(nodes, labels), "rest"), scratch.table)


def landmark_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The same of recordings that share a landmark: star rounds, then the landmarks' rest by blocks, as in `linking`."""
    held = nodes.select("id", "codes")
    # Nearly all landmarks are of one recording only; their places are made again for those that are not, rather than written.
    shared = scratch.table(held.mapInArrow(marks, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = scratch.table(held.mapInArrow(postings, "key long, id long, size int, lo int, hi int").join(shared, "key"), "buckets")
    central = rows.groupBy("id").agg(F.sum("n").alias("met"))
    top = rows.select("key", "id").join(central, "id").groupBy("key").agg(F.max_by("id", "met").alias("hub"))

    def near(table: DataFrame, other: DataFrame, on: list[str], more: str = "true") -> DataFrame:
        met = table.join(other, on).where(f"{MEETS} and {more}")
        return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), F.least("label", "other").alias("la"), F.greatest("label", "other").alias("lb")).distinct()

    def as_other(table: DataFrame, *more) -> DataFrame:
        return table.select("key", F.col("id").alias("x"), F.col("size").alias("sx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"), F.col("label").alias("other"), *more)

    def of_hubs(table: DataFrame, hubs: DataFrame) -> DataFrame:
        return as_other(table.join(hubs, "key").where("id = hub"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links as pairs of labels, the edges by which components grow."""
        p = pairs.join(nodes.select(F.col("id").alias("b"), F.col("codes").alias("pb")), "b").join(nodes.select(F.col("id").alias("a"), F.col("codes").alias("pa")), "a")
        links = p.select("pa", "pb", F.col("la").alias("a"), F.col("lb").alias("b")).mapInArrow(accepted(linked), "a long, b long")
        return scratch.table(links, "links")

    def by_blocks(marked: DataFrame) -> DataFrame:
        """Pairs of a landmark's recordings in different components; a hot landmark is dealt over pairs of blocks."""
        full = marked.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("id"), "blocks"))
        one = full.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
        two = as_other(full, F.col("i").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j"))))
        return near(one, two, ["key", "i", "j"], "label <> other and (i < j or id < x)")

    alone = rows.withColumn("label", F.col("id"))
    pairs = scratch.table(near(alone, of_hubs(alone, top), ["key"]), "pairs")
    tested = pairs.select("a", "b")
    labels = connected_components(confirm(pairs), scratch.table)
    before = None
    for r in range(ROUNDS):
        marked = rows.drop("n").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        sides = marked.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("major"))
        marked = scratch.table(marked.join(sides.where("most < n").drop("most"), "key"), "open")
        work, left = marked.agg(F.sum(F.when(F.col("label") != F.col("major"), F.col("n"))), F.count("*")).first()
        if not work:
            return labels
        # Rounds go on while each halves what is left.
        last = r == ROUNDS - 1 or work <= LIGHT * left or before is not None and work > 0.5 * before
        before = work
        if last:
            pairs = by_blocks(marked)
        else:
            hubs = marked.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(r))).alias("hub"))
            pairs = near(marked, of_hubs(marked, hubs), ["key"], "label <> other")
        pairs = scratch.table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs.select("a", "b"))
        labels = grown_components(labels, confirm(pairs), scratch.table)
        if last:
            break
    return labels


def recordings(spark: SparkSession, audio: DataFrame) -> DataFrame:
    """audio (doc_id, audio binary) to doc_id, n_codes, n_distinct, class_id, is_first: one row per recording."""
    scratch = Scratch(spark, "chroma")
    audio = audio.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("audio").cast("binary").alias("audio"))
    signed = scratch.table(audio.mapInArrow(signatures, SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    found = classes(signed.select("row", "doc_id", "digest", "codes"), ["codes"], lambda nodes: link_recordings(nodes, scratch), scratch)
    found = scratch.table(found, "moved")
    class_id = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_codes", "n_distinct").join(found, "doc_id", "left").select("doc_id", "n_codes", "n_distinct", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("is_first"))
