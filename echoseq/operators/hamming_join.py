"""Exact Hamming radius join by multi-index hashing (Norouzi, Punjani, Fleet 2012).

A code is cut into s bands. Two codes within t differ by at most t // s in one of the first t % s + 1 bands
or by less than t // s in one of the others; so codes are compared whose values of a band, their cells, lie within that
radius. A pair that meets in several bands is reported in its first band alone.

Codes travel as packed blocks to groups of cells, the cells that share the upper bits of the band's value, and a group is
also sent to the greater groups within the radius of it. So a code is shipped a few times a band however many cells are near
its own; cells are looked up inside a task, and a cell is compared with all near it by vectorised XOR and popcount. More
bands mean more comparisons; the number is chosen by cost from the number of codes, down to no bands (all codes in one cell)
for few codes or a wide radius. A group with more codes than CELL is split, and every part meets every other. The join runs on
distinct codes; frames come back afterwards. Where only the pairs of some flagged codes are asked for, those alone are compared with all others.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: What shipping a copy of a code costs, in verifications of a pair.
SHIP = 300
#: Codes of a block, codes of a part of a group (and of a part without bands), codes that a task sorts at once, and pairs verified at once.
BLOCK, CELL, WHOLE_CELL, STEP, PAIRS = 1 << 17, 1 << 20, 1 << 14, 1 << 20, 1 << 17
#: Codes of a cell, on average, from which comparing outweighs looking cells up.
DENSE = 32
#: Rows of a batch of results.
OUT = 1 << 16
#: Rows of a code that one part of a join on codes takes.
ROWS = 256
#: The plan without bands: every code in one cell.
WHOLE = [(0, 0, 0)]


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def bands(t: int, s: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the bands that are probed when codes are cut into s."""
    a, edge = t // s, [64 * i // s for i in range(s + 1)]
    cut = [(edge[i], edge[i + 1] - edge[i], a if i <= t - s * a else a - 1) for i in range(s)]
    return [b for b in cut if b[2] >= 0]


def high_bits(plan: list[tuple[int, int, int]], n: float, tasks: int = 1) -> list[int]:
    """Upper bits of each band by which n codes are dealt to groups: of up to CELL codes, and to so many tasks at least."""
    bits = max(0, ceil(log2(max(n / CELL, tasks / len(plan), 1))))
    return [min(w, bits) for _, w, _ in plan]


def copies(plan: list[tuple[int, int, int]], high: list[int]) -> float:
    """Copies of a code that are shipped: to its own groups and half of those near them."""
    return sum(1 + (sum(comb(g, k) for k in range(r + 1)) - 1) / 2 for (_, _, r), g in zip(plan, high, strict=True))


def cost(plan: list[tuple[int, int, int]], n: int) -> float:
    """In verifications, for n evenly spread codes."""
    share = sum(sum(comb(w, k) for k in range(r + 1)) / 2**w for _, w, r in plan)
    return SHIP * n * copies(plan, high_bits(plan, n)) + share * n * n / 2


def choose(t: int, n: int) -> list[tuple[int, int, int]]:
    """The cheapest plan for n codes."""
    plans = [p for p in (bands(t, s) for s in range(3, 17)) if n >= DENSE << max(w for _, w, _ in p)]
    return min([WHOLE, *plans], key=lambda p: cost(p, n))


def steps(batches, size: int):
    """Codes, and what else comes with them, in runs of at least `size`, the last one shorter."""
    held, n = [], 0
    for rb in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in rb.columns])
        n += rb.num_rows
        if n >= size:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


BLOCKS = "band int, cell long, probe int, n long, codes binary"


def blocks(band: int, cell: np.ndarray, codes: np.ndarray, probe: int = 0) -> pa.RecordBatch:
    """A row for each cell, or for each BLOCK codes of it."""
    order = np.argsort(cell, kind="stable")
    cell, codes = cell[order], codes[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(cell)])
    parts = -(-size // BLOCK)
    at = np.repeat(first, parts) + BLOCK * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = pa.array(8 * np.r_[at, len(cell)], pa.int64())
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())]).cast(pa.binary())
    number = lambda x, t: pa.array(np.full(len(at), x), t)
    return pa.RecordBatch.from_arrays([number(band, pa.int32()), pa.array(cell[at].astype(np.int64)), number(probe, pa.int32()), pa.array(np.diff(np.r_[at, len(cell)]).astype(np.int64)), packed], ["band", "cell", "probe", "n", "codes"])


def place(plan: list[tuple[int, int, int]], high: list[int] | None = None):
    """Blocks of the codes of a task in their cells, or in their groups of cells. Where codes come with a flag, all are probes and those that have it are stored."""

    def run(batches):
        for h, *flag in steps(batches, STEP):
            h = h.view(np.uint64)
            for k, (shift, width, _) in enumerate(plan):
                cell = (h >> np.uint64(shift) & np.uint64((1 << width) - 1)) >> np.uint64(width - (high[k] if high else width))
                if flag:
                    yield blocks(k, cell, h, 1)
                    yield blocks(k, cell[flag[0]], h[flag[0]])
                else:
                    yield blocks(k, cell, h)

    return run


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n numbers each, one after the other."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - end + n, n)


def meetings(own: np.ndarray, other: np.ndarray, plan: list[tuple[int, int, int]], k: int, t: int, mutual: bool = True):
    """(i, j, dist) of pairs within t that band k is the first to bring together: own[i] with (own + other)[j].

    A pair of own codes comes once, or not at all unless mutual. Cells are visited in order, each with the near cells of other
    codes and the lesser ones of own codes.
    """
    shift, width, radius = plan[k]
    near = np.array(masks(width, radius), np.int64)
    cells = lambda h: (h >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
    ci, cj = cells(own), cells(other)
    oi, oj = np.argsort(ci, kind="stable"), np.argsort(cj, kind="stable")
    ci, cj, a, b = ci[oi], cj[oj], own[oi], other[oj]
    first = np.flatnonzero(np.r_[True, ci[1:] != ci[:-1]]) if len(ci) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ci)], strict=True):
        there = ci[lo] ^ near
        y, j = [], []
        if mutual:
            less = there[there < ci[lo]]
            s, e = np.searchsorted(ci, less), np.searchsorted(ci, less, "right")
            at = ranges(s, e - s)
            y, j = [a[at], a[lo:hi]], [oi[at], oi[lo:hi]]
        if len(cj):
            s, e = np.searchsorted(cj, there), np.searchsorted(cj, there, "right")
            m = ranges(s, e - s)
            y, j = [b[m], *y], [len(own) + oj[m], *j]
        y, j = np.concatenate(y), np.concatenate(j)
        if not len(y):
            continue
        itself = len(y) - (hi - lo) if mutual else len(y)
        size = max(1, PAIRS // len(y))
        for p in range(lo, hi, size):
            z = a[p : min(p + size, hi), None] ^ y[None, :]
            d = np.bitwise_count(z).ravel()
            hit = np.flatnonzero(d <= t)
            if not len(hit):
                continue
            row, col = np.divmod(hit, len(y))
            # Of the codes of this cell only those that come later.
            ok = (col < itself) | (col - itself > row + p - lo)
            z = z.ravel()[hit]
            for earlier, w, r in plan[:k]:
                ok &= np.bitwise_count(z >> np.uint64(earlier) & np.uint64((1 << w) - 1)) > r
            if ok.any():
                yield oi[p + row[ok]], j[col[ok]], d[hit[ok]]


def as_rows(found, codes: np.ndarray):
    """(h1, h2, dist) with h1 < h2."""
    h = codes.view(np.int64)
    for i, j, d in gathered(found):
        x, y = h[i], h[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d.astype(np.int32))], ["h1", "h2", "dist"])


def as_counts(found, codes: np.ndarray):
    """(dist, n): how many pairs there are of each distance."""
    total = np.zeros(65, np.int64)
    for _, _, d in found:
        total += np.bincount(d, minlength=65)
    dist = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(dist.astype(np.int32)), pa.array(total[dist])], ["dist", "n"])


def of_own(found, codes: np.ndarray):
    """(h1, h2, dist) with h1 of the own codes, but for a code with itself."""
    h = codes.view(np.int64)
    for i, j, d in gathered((i[on], j[on], d[on]) for i, j, d in found if len(on := np.flatnonzero(d))):
        yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(h[j]), pa.array(d.astype(np.int32))], ["h1", "h2", "dist"])


def gathered(found):
    """The same arrays in batches of OUT rows or so."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= OUT:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def verify(plan: list[tuple[int, int, int]], t: int, mutual: bool = True, rows=None):
    """`rows` of the pairs within t of rows (band, cell, part, probe, codes) that come sorted by cell and part, stored codes first."""

    def run(batches):
        key, held = None, ([], [])

        def met():
            if held[0] and (mutual or held[1]):
                own, other = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held)
                yield from (rows or (as_rows if mutual else of_own))(meetings(own, other, plan, key[0], t, mutual), np.concatenate([own, other]))

        for rb in batches:
            for *here, probe, codes in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if here != key:
                    yield from met()
                    key, held = here, ([], [])
                if probe == 0 or mutual or held[0]:
                    held[probe].append(np.frombuffer(codes, np.uint64))
        yield from met()

    return run


PAIR = "h1 long, h2 long, dist int"


def dealt(codes: DataFrame, plan: list[tuple[int, int, int]], n: int) -> tuple[list[int], DataFrame]:
    """Upper bits of the bands, and the groups (band, cell, n) of the codes: counted from the codes, so blocks needn't be written."""
    high = high_bits(plan, n, 4 * codes.sparkSession.sparkContext.defaultParallelism)
    cell = lambda s, w, g: F.shiftrightunsigned("h", s + w - g).bitwiseAND(F.lit((1 << g) - 1).cast("long")) if g else F.lit(0).cast("long")
    group = [F.struct(F.lit(k).alias("band"), cell(s, w, g).alias("cell")) for k, ((s, w, _), g) in enumerate(zip(plan, high, strict=True))]
    return high, codes.select(F.explode(F.array(*group)).alias("g")).groupBy("g.band", "g.cell").agg(F.count("*").alias("n"))


def code_pairs(codes: DataFrame, t: int, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(h1, h2, dist) of distinct codes (h) with h1 < h2 and distance t or less, each pair once. codes is read more than once."""
    if not 0 <= t <= 64:
        raise ValueError("threshold must be 0 to 64")
    codes = codes.where("h is not null").select("h")
    n = codes.count()
    plan = plan or choose(t, n)
    high, sizes = dealt(codes, plan, n)
    return group_pairs(codes.mapInArrow(place(plan, high), BLOCKS), sizes, t, plan, high)


def flagged_pairs(codes: DataFrame, t: int, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(h1, h2, dist) of two different codes within t, h1 one that is flagged. codes: h distinct, flag; read more than once."""
    n = codes.count()
    plan = plan or choose(t, n)
    high, sizes = dealt(codes, plan, n)
    return group_pairs(codes.select("h", "flag").mapInArrow(place(plan, high), BLOCKS), sizes, t, plan, high, False)


def placed(codes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(band, cell, probe, n, codes): the packed blocks of distinct codes (h) in the cells of a plan. probe is 0."""
    return codes.where("h is not null").select("h").mapInArrow(place(plan), BLOCKS)


def block_pairs(rows: DataFrame, t: int, plan: list[tuple[int, int, int]], counts: bool = False) -> DataFrame:
    """(h1, h2, dist) from a written table of blocks; with counts, (dist, n) for the tasks' pairs, which stay where they are found."""
    rows = rows.where("probe = 0")
    n = rows.where("band = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    high = high_bits(plan, n, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    low = per_band([F.lit(w - g) for (_, w, _), g in zip(plan, high, strict=True)])
    rows = rows.withColumn("low", low).select("band", F.expr("shiftright(cell, low)").alias("cell"), "probe", "n", "codes")
    return group_pairs(rows, rows.groupBy("band", "cell").agg(F.sum("n").alias("n")), t, plan, high, counts=counts)


def per_band(values: list[Column]) -> Column:
    return F.get(F.array(*values), "band")


def group_pairs(rows: DataFrame, sizes: DataFrame, t: int, plan: list[tuple[int, int, int]], high: list[int], mutual: bool = True, counts: bool = False) -> DataFrame:
    """Pairs, or their counts, from blocks (band, cell, probe, codes) by groups of cells, and the groups' numbers of codes.

    Mutual: stored blocks meet each other. Else stored ones meet probes only.
    """
    long = lambda x: F.lit(x).cast("long")
    there = per_band([F.array(*[long(m) for m in masks(g, r)]) for (_, _, r), g in zip(plan, high, strict=True)])
    # Stored blocks probe greater groups; probes go to all groups near theirs, and stored blocks that meet only them stay.
    there = there if mutual else F.when(F.col("probe") == 1, there).otherwise(F.array(long(0)))
    rows = rows.withColumn("id", F.xxhash64("codes")).withColumn("own", F.col("cell")).withColumn("mask", F.explode(there))
    rows = rows.withColumn("cell", F.col("own").bitwiseXOR(F.col("mask")))
    rows = rows.where("cell >= own") if mutual else rows
    # Parts of a full group: a stored block is of one part and probes the later ones, a block of another group probes all.
    # A probe is of one part, and blocks that meet only probes are stored in all.
    full = sizes.withColumn("parts", F.ceil(F.col("n") / (min(CELL, WHOLE_CELL) if plan == WHOLE else CELL))).where("parts > 1").select("band", "cell", "parts")
    rows = rows.join(F.broadcast(full), ["band", "cell"], "left").withColumn("parts", F.coalesce("parts", long(1)))
    part = F.pmod("id", "parts")
    first = F.when(F.col("mask") == 0, part).otherwise(long(0)) if mutual else F.when(F.col("probe") == 1, part).otherwise(long(0))
    last = F.col("parts") - 1 if mutual else F.when(F.col("probe") == 1, part).otherwise(F.col("parts") - 1)
    rows = rows.withColumn("first", first).select("band", "cell", F.explode(F.sequence("first", last)).alias("part"), "first", "mask", "probe", "codes")
    if mutual:
        rows = rows.withColumn("probe", F.when((F.col("mask") == 0) & (F.col("part") == F.col("first")), F.lit(0)).otherwise(F.lit(1)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("band", "cell", "part", "probe", "codes").repartition(tasks, "band", "cell", "part").sortWithinPartitions("band", "cell", "part", "probe")
    return rows.mapInArrow(verify(plan, t, mutual, as_counts if counts else None), "dist int, n long" if counts else PAIR)


def density(codes: DataFrame) -> DataFrame:
    """codes (h, k) with `near`, a guess at the logarithm of how many of the k frames a code are near each: as if bands were independent."""
    cut = [(64 * i // 6, 64 * (i + 1) // 6 - 64 * i // 6) for i in range(6)]
    cells = [F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("c")) for b, (s, w) in enumerate(cut)]
    # At most 2048 cells a band, however many codes there are.
    found = codes.select("k", F.explode(F.array(*cells)).alias("x")).groupBy("x.b", "x.c").agg(F.sum("k").alias("n")).collect()
    rate = np.zeros((len(cut), 1 << max(w for _, w in cut)))
    for r in found:
        rate[r["b"], r["c"]] = np.log2(r["n"])

    def run(batches):
        for rb in batches:
            h = rb.column(0).to_numpy().view(np.uint64)
            near = sum(rate[b, (h >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64)] for b, (s, w) in enumerate(cut))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(near + np.zeros(len(h)))], ["h", "k", "near"])

    return codes.select("h", "k").mapInArrow(run, "h long, k long, near double")


def near_codes(frames: DataFrame, t: int) -> DataFrame:
    """(h1, h2, dist), both directions and each code with itself. A written table: callers join it more than once."""
    return near_of(frames, t)


def near_of(frames: DataFrame, t: int, plan: list[tuple[int, int, int]] | None = None, blocks: DataFrame | None = None, written: bool = True) -> DataFrame:
    """The same from blocks that are there already, for the plan that made them. Not written, it is for one reader."""
    scratch = Scratch(frames.sparkSession, "codes")
    codes = scratch.table(frames.select("h").distinct(), "distinct")
    pairs = code_pairs(codes, t, plan) if blocks is None else block_pairs(blocks, t, plan)
    one, two = F.struct("h1", "h2", "dist"), F.struct(F.col("h2").alias("h1"), F.col("h1").alias("h2"), "dist")
    both = pairs.select(F.explode(F.array(one, two)).alias("p")).select("p.*")
    itself = codes.select(F.col("h").alias("h1"), F.col("h").alias("h2"), F.lit(0).alias("dist"))
    near = both.unionByName(itself)
    return scratch.table(near, "near") if written else near


def near_counts(codes: DataFrame, t: int, plan: list[tuple[int, int, int]], blocks: DataFrame) -> DataFrame:
    """(dist, n): rows of near codes by distance, from the blocks of the distinct codes. Pairs are counted where they are found."""
    both = block_pairs(blocks, t, plan, True).select("dist", (2 * F.col("n")).alias("n"))
    return both.unionByName(codes.select(F.lit(0).alias("dist"), F.lit(1).cast("long").alias("n"))).groupBy("dist").agg(F.sum("n").alias("n"))


def spread_join(half: DataFrame, other: DataFrame) -> DataFrame:
    """Joined on h2. A code with more than ROWS rows of `other` is split by them into parts, and so over tasks."""
    full = other.groupBy("h2").agg(F.ceil(F.count("*") / ROWS).alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    split = other.join(full, "h2", "left").select(*other.columns, F.pmod(F.xxhash64(*other.columns), parts).alias("part"))
    all_parts = half.join(full, "h2", "left").select(*half.columns, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    tasks = int(half.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return all_parts.repartition(tasks, "h2", "part").join(split, ["h2", "part"]).drop("part")


def frame_pairs(frames: DataFrame, t: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(va, ia, vb, ib, dist) of frames of two videos, va < vb, with distance t or less; columns to carry come as x_a and x_b.

    With nothing to carry they are found in blocks of videos, and not shuffled.
    """
    if not carry:
        from . import pair_blocks as B  # it is built on this module

        found = B.pairs_of_blocks(frames, t, B.frame_rows, "va long, ia long, vb long, ib long, dist int")
        kind = {c: frames.schema[c].dataType for c in ("video_id", "frame_idx")}
        return found.select(*(F.col(c).cast(kind["video_id" if c[0] == "v" else "frame_idx"]).alias(c) for c in ("va", "ia", "vb", "ib")), "dist")
    side = lambda h, v: [F.col("h").alias(h), F.col("video_id").alias(f"v{v}"), F.col("frame_idx").alias(f"i{v}"), *[F.col(c).alias(f"{c}_{v}") for c in carry]]
    half = near_of(frames, t, written=False).join(frames.select(*side("h1", "a")), "h1")
    return spread_join(half, frames.select(*side("h2", "b"))).where("va < vb").select("va", "ia", "vb", "ib", "dist", *[f"{c}_{v}" for c in carry for v in "ab"])


def candidate_pairs(frames: DataFrame, t: int, without: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: videos with a frame pair, but for given pairs (a, b). They are found in blocks of videos, each once, and not shuffled."""
    from . import pair_blocks as B  # it is built on this module

    kind = frames.schema["video_id"].dataType
    found = B.pairs_of_blocks(frames, t, B.candidate_rows(False), "a long, b long", without=without)
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))


def knn_candidate_pairs(frames: DataFrame, t: int, k: int = 16) -> DataFrame:
    """Candidates as k nearest neighbours see them: of a frame's k nearest (itself and its video's frames
    included, ties by video and place) those of other videos within t.

    Frames with one code have the same neighbours, and of a code's frames only the first k can be among
    them, so lists are made per code.
    """
    place = F.row_number().over(Window.partitionBy("h").orderBy("video_id", "frame_idx"))
    first = frames.select("h", "video_id", "frame_idx", place.alias("place")).where(F.col("place") <= k)
    near = near_of(frames, t, written=False).join(first.select(F.col("h").alias("h2"), F.col("video_id").alias("v"), F.col("frame_idx").alias("i")), "h2")
    rank = F.row_number().over(Window.partitionBy("h1").orderBy("dist", "v", "i"))
    lists = near.select("h1", "v", rank.alias("rank")).where(F.col("rank") <= k).select("h1", "v").distinct()
    own = frames.select(F.col("h").alias("h1"), F.col("video_id").alias("q")).distinct()
    met = own.join(lists, "h1").where("q <> v")
    return met.select(F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b")).distinct()
