"""From frame pairs to matches: alignment scores, gates and types."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import pair_blocks, planes
from .hamming_join import density, flagged_pairs, frame_pairs, near_codes, ranges, spread_join

#: Bytes of codes of a block of videos; alignments, and frames of them, that a task compares at once.
BLOCK_BYTES, ALIGNMENTS, COMPARED = 1 << 26, 1 << 17, 1 << 19
#: Videos of a class that one row holds, and pairs of videos of a batch of results.
MEMBERS, OUT = 256, 1 << 16
#: Frames of a large block of videos, and small blocks a core at least.
FRAMES, BLOCKS = 1 << 22, 8
FOUND = "short_id long, long_id long, short_duration double, long_duration double, n long, start long, hits long"


@dataclass(frozen=True)
class MatchParams:
    """window: least duration of the shorter video (min_duration). nprobe and workers are accepted and inert: the join is exact."""

    filter_length: bool = False
    window: float = 10.0
    frame_step: int = 3
    threshold: int = 10
    min_confidence: float = 0.8
    workers: int = 4
    nprobe: int = 32

    def __post_init__(self):
        if not 0 <= self.threshold <= 64 or self.frame_step < 1:
            raise ValueError("threshold must be 0 to 64, frame_step 1 or more")
        if self.min_confidence <= 0:
            raise ValueError("min_confidence must be positive: at 0 every candidate would be a match")

    def args(self) -> dict:
        return asdict(self)


def duration(c: str = "duration") -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def orient(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """(a, b) to short and long by duration, a tie keeps a short; pairs with an unknown video go. Further columns stay."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    v = videos.select("id", duration().alias("d"), "n_frames")
    x = v.select(F.col("id").alias("a"), F.col("d").alias("da"), F.col("n_frames").alias("na"))
    y = v.select(F.col("id").alias("b"), F.col("d").alias("db"), F.col("n_frames").alias("nb"))
    p = pairs.join(x, "a").join(y, "b")
    s = F.col("da") <= F.col("db")
    pick = lambda l, r, name: F.when(s, F.col(l)).otherwise(F.col(r)).alias(name)
    return p.select("a", "b", pick("a", "b", "short_id"), pick("b", "a", "long_id"), pick("da", "db", "short_duration"), pick("db", "da", "long_duration"), pick("na", "nb", "n"), pick("nb", "na", "m"), *more)


def all_pairs(videos: DataFrame, filter_length: bool = False) -> DataFrame:
    """Every pair of videos, oriented: the exhaustive candidates that small collections may ask for."""
    x, y = videos.select(F.col("id").alias("a"), duration().alias("da")), videos.select(F.col("id").alias("b"), duration().alias("db"))
    p = x.join(y, F.col("a") < F.col("b"))
    p = p.where("da <> db") if filter_length else p
    s = F.col("da") <= F.col("db")
    return p.select(F.when(s, F.col("a")).otherwise(F.col("b")).alias("short_id"), F.when(s, F.col("b")).otherwise(F.col("a")).alias("long_id"))


def match_type(short: str = "short_duration", long: str = "long_duration") -> Column:
    return F.when(F.col(long) == 0, "duplicate").when(F.col(short) / F.col(long) >= 0.95, "duplicate").otherwise("subclip")


def uncompared(pairs: DataFrame, comparisons: DataFrame | Column) -> DataFrame:
    """Pairs (a, b) that no comparison has recorded, in either order. Where a rule on a and b tells which of the pairs are recorded, no table of
    them is needed, and nothing is shuffled."""
    if isinstance(comparisons, Column):
        return pairs.where(~F.coalesce(comparisons, F.lit(False)))
    done = comparisons.select(F.least("video_a_id", "video_b_id").alias("a"), F.greatest("video_a_id", "video_b_id").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def gate(oriented: DataFrame, p: MatchParams) -> tuple[DataFrame, DataFrame]:
    """(eligible, too short). With filter_length, equal durations are in neither."""
    both = split(oriented, p)
    return both.where("not too_short").drop("too_short"), both.where("too_short").drop("too_short")


def split(oriented: DataFrame, p: MatchParams) -> DataFrame:
    """The pairs that pass filter_length, with too_short: what `gate` parts, read once."""
    kept = oriented.where("short_duration <> long_duration") if p.filter_length else oriented
    return kept.withColumn("too_short", F.col("short_duration") < p.window)


def matches(frames: DataFrame, videos: DataFrame, p: MatchParams, comparisons: DataFrame | Column | None = None) -> DataFrame:
    """short_id, long_id, match_type, confidence. `frames` must be a written table: it is read several times.

    Videos of equal codes and duration are compared as one; neither near codes nor alignments nor matches are written or shuffled,
    only the pairs of such classes that a telling frame brings together. Of sequences of few codes, not even those.
    """
    scratch = Scratch(frames.sparkSession, "match")
    classes, members = sequence_classes(frames, videos, scratch)
    few = few_codes(classes, p)
    if few is None:
        found = best_in_blocks(class_pairs(classes, members, p, scratch), classes, members, p, scratch)
    else:
        found = all_in_blocks(classes, members, few, planes.best_of_all(int(few[1].max()), p.frame_step, p.min_confidence, p.window), scratch, p.filter_length)
    found = found.withColumn("confidence", F.col("hits") / F.col("n"))
    out = found.select("short_id", "long_id", match_type().alias("match_type"), "confidence")
    if comparisons is None:
        return out
    # Flags instead of the ids in order and the type, so less is shuffled.
    out = found.select(F.least("short_id", "long_id").alias("a"), F.greatest("short_id", "long_id").alias("b"), (F.col("short_id") < F.col("long_id")).alias("a_short"), (match_type() == "duplicate").alias("duplicate"), "confidence")
    pick = lambda x, y: F.when(F.col("a_short"), F.col(x)).otherwise(F.col(y))
    return uncompared(out, comparisons).select(pick("a", "b").alias("short_id"), pick("b", "a").alias("long_id"), F.when(F.col("duplicate"), "duplicate").otherwise("subclip").alias("match_type"), "confidence")


def candidates(frames: DataFrame, videos: DataFrame, p: MatchParams) -> DataFrame:
    """(a, b), a < b: the pairs that `matches` compares, each once."""
    scratch = Scratch(frames.sparkSession, "match")
    classes, members = sequence_classes(frames, videos, scratch)
    few = few_codes(classes, p)
    if few is not None:
        met = all_in_blocks(classes, members, few, planes.all_of_all(p.window), scratch, p.filter_length)
        return met.select(F.least("short_id", "long_id").alias("a"), F.greatest("short_id", "long_id").alias("b"))
    pairs = class_pairs(classes, members, p, scratch)
    # Of one duration, a pair of classes comes in either order or both; the order that is not by duration gives no pair of videos.
    pairs = pairs.union(pairs.select("long_id", "short_id")).distinct()
    bare = classes.select("video_id", "d", F.array().cast("array<long>").alias("codes"))
    met = in_blocks(pairs, bare, members, 4, member_rows(), scratch)
    return met.select(F.least("short_id", "long_id").alias("a"), F.greatest("short_id", "long_id").alias("b"))


def sequence_classes(frames: DataFrame, videos: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(video_id, d, codes): a video of every class of equal codes and duration; (rep, id): all videos by that of their class."""
    own = sequences(frames).join(videos.select(F.col("id").alias("video_id"), duration().alias("d")), "video_id")
    digest = F.md5(F.array_join(F.col("codes").cast("array<string>"), ",", "-").cast("binary")).alias("digest")
    own = scratch.table(own.select("video_id", "d", "codes", digest), "codes")
    rep = own.groupBy("digest", "d").agg(F.min("video_id").alias("rep"))
    members = scratch.table(own.select("video_id", "digest", "d").join(rep, ["digest", "d"]).select("rep", F.col("video_id").alias("id")), "members")
    classes = scratch.table(own.join(members.where("rep = id").select(F.col("id").alias("video_id")), "video_id", "left_semi").select("video_id", "d", "codes"), "classes")
    scratch.drop(own)
    return classes, members


def few_codes(classes: DataFrame, p: MatchParams) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, their numbers) if codes are few and so common that telling frames make more votes than there are pairs of classes."""
    codes = classes.select(F.explode("codes").alias("h")).where("h is not null")
    if codes.agg(F.approx_count_distinct("h")).first()[0] > 2 * planes.CODES:
        return None
    counts = codes.groupBy("h").count().limit(planes.CODES + 1).collect()
    if not 0 < len(counts) <= planes.CODES:
        return None
    n = F.size("codes")
    told = F.sum(F.when(F.col("d") >= p.window, n - F.ceil(n * p.min_confidence - 1e-6) + 1))
    many, told = classes.agg(F.count("*"), F.coalesce(told, F.lit(0))).first()
    # At least so many votes: the rarest codes are telling.
    k = np.sort(np.array([r["count"] for r in counts], np.int64))
    if sum(int(a) * int(b) for a, b in zip(np.minimum(k, np.maximum(told - (np.cumsum(k) - k), 0)), k, strict=True)) <= many**2:
        return None
    codes = np.sort(np.array([r["h"] for r in counts], np.int64).view(np.uint64))
    number = planes.numbers(codes, p.threshold)
    return None if number is None else (codes, number)


def class_pairs(classes: DataFrame, members: DataFrame, p: MatchParams, scratch: Scratch) -> DataFrame:
    """(short_id, long_id) of classes that may match and pass the gates, a class with itself if it has several videos. Classes of one
    duration come in both orders: either may be the shorter one."""
    frames = scratch.table(classes.select("video_id", F.posexplode("codes").alias("frame_idx", "h")), "frames")
    lengths = classes.select("video_id", "d", F.size("codes").cast("long").alias("n"))
    codes = scratch.table(frames.groupBy("h").agg(F.count("*").alias("k")), "distinct")
    told = scratch.table(rarest(frames, lengths.select(F.col("video_id").alias("id"), F.col("n").alias("n_frames")), density(codes), p.min_confidence).join(lengths.where(F.col("d") >= p.window).drop("n"), "video_id"), "telling")
    used = [frames, codes, told]
    shorter = "short_id <> long_id and short_duration " + ("<" if p.filter_length else "<=") + " long_duration"
    side = lambda x: lengths.select(F.col("video_id").alias(f"{x}_id"), F.col("d").alias(f"{x}_duration"), F.col("n").alias("n" if x == "short" else "m"))
    if (told.join(codes, "h").agg(F.sum("k")).first()[0] or 0) > classes.count() ** 2:
        # Frames that most videos share: all pairs are fewer than the votes for them.
        pairs = side("short").where(F.col("short_duration") >= p.window).crossJoin(side("long")).where(shorter).where("n <= m").select("short_id", "long_id")
    else:
        flags = scratch.table(codes.join(told.select("h").distinct().withColumn("flag", F.lit(True)), "h", "left").select("h", F.coalesce("flag", F.lit(False)).alias("flag")), "flags")
        itself = flags.where("flag").select(F.col("h").alias("h1"), F.col("h").alias("h2"))
        near = scratch.table(flagged_pairs(flags, p.threshold).select("h1", "h2").unionByName(itself), "near")
        one = told.select(F.col("video_id").alias("short_id"), F.col("frame_idx").alias("i"), F.col("h").alias("h1"), F.col("d").alias("short_duration")).join(side("short").select("short_id", "n"), "short_id")
        two = frames.select(F.col("video_id").alias("long_id"), F.col("frame_idx").alias("j"), F.col("h").alias("h2")).join(side("long"), "long_id")
        met = spread_join(one.join(near, "h1").drop("h1"), two).withColumn("start", F.col("j") - F.col("i")).where(shorter)
        met = met.where((F.col("start") >= 0) & (F.col("start") <= F.col("m") - F.col("n")) & (F.col("start") % p.frame_step == 0))
        pairs = met.select("short_id", "long_id").distinct()
        used += [flags, near]
    if not p.filter_length:
        several = members.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select(F.col("rep").alias("video_id"))
        alike = lengths.where(F.col("d") >= p.window).join(several, "video_id").select(F.col("video_id").alias("short_id"), F.col("video_id").alias("long_id"))
        pairs = pairs.unionByName(alike)
    pairs = scratch.table(pairs, "pairs")
    scratch.drop(*used)
    return pairs


def best_in_blocks(pairs: DataFrame, classes: DataFrame, members: DataFrame, p: MatchParams, scratch: Scratch) -> DataFrame:
    """short_id, long_id, short_duration, long_duration, n, start, hits of the videos of pairs of classes (short_id, long_id) whose best
    alignment on the step grid, ties to the first one, reaches min_confidence."""
    codes = classes.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    n = max(4, -(-8 * codes // BLOCK_BYTES))
    return in_blocks(pairs, classes, members, n, best_rows(p.threshold, p.frame_step, p.min_confidence), scratch, p.window)


def in_blocks(pairs: DataFrame, classes: DataFrame, members: DataFrame, n: int, run, scratch: Scratch, window: float | None = None) -> DataFrame:
    """What `run` makes of pairs of classes, which are dealt to n blocks: a task gets the codes and members of two.

    So codes and members are shipped once a pair of blocks and not with every pair, and members' pairs are not shuffled. A class
    of more than MEMBERS videos is several, each with the same codes.
    """
    units = scratch.table(units_of(members), "units")
    more = scratch.table(units.groupBy("rep").agg(F.collect_list("unit").alias("units")).where(F.size("units") > 1), "more")
    for x in ("short_id", "long_id"):
        split = more.select(F.col("rep").alias(x), F.col("units").alias("split"))
        others = [c for c in pairs.columns if c != x]
        pairs = pairs.join(split, x, "left").select(*others, F.explode(F.coalesce("split", F.array(x))).alias(x))
    units = classes.join(units.withColumnRenamed("rep", "video_id"), "video_id")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda t: F.lit(None).cast(t)
    own = (F.col("unit").alias("x"), null("long").alias("y"), "d", "codes", "ids")
    shorter = units if window is None else units.where(F.col("d") >= window)
    rows = shorter.select(block("unit").alias("i"), every.alias("j"), F.lit(0).alias("kind"), *own)
    rows = rows.unionByName(units.select(every.alias("i"), block("unit").alias("j"), F.lit(1).alias("kind"), *own))
    rows = rows.unionByName(pairs.select(block("short_id").alias("i"), block("long_id").alias("j"), F.lit(2).alias("kind"), F.col("short_id").alias("x"), F.col("long_id").alias("y"), null("double").alias("d"), null("array<long>").alias("codes"), null("array<long>").alias("ids")))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(min(tasks, n * n), "i", "j").sortWithinPartitions("i", "j", "kind")
    return rows.mapInArrow(block_rows(run), FOUND)


def units_of(members: DataFrame) -> DataFrame:
    """(rep, unit, ids): up to MEMBERS videos of a class, by the least id of them."""
    part = F.floor((F.row_number().over(Window.partitionBy("rep").orderBy("id")) - 1) / MEMBERS)
    units = members.withColumn("part", part).groupBy("rep", "part").agg(F.min("id").alias("unit"), F.sort_array(F.collect_list("id")).alias("ids"))
    return units.select("rep", "unit", "ids")


def all_in_blocks(classes: DataFrame, members: DataFrame, few: tuple[np.ndarray, np.ndarray], run, scratch: Scratch, strict: bool) -> DataFrame:
    """What `run` makes of all pairs of classes of few codes: small blocks of videos meet large ones in a product that shuffles no pairs.

    strict: only of different durations."""
    kind = np.uint8 if few[1].max() < 255 else np.uint16
    frames = classes.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    own = classes.mapInArrow(numbered_rows(*few, kind), "video_id long, d double, codes binary")
    own = scratch.table(own.join(units_of(members).withColumnRenamed("rep", "video_id"), "video_id").select("d", "codes", "ids"), "units")
    names = ("d", "size", "codes", "many", "ids")
    schema = "i int, " + ", ".join(f"{c} binary" for c in names)
    large = max(1, -(-frames // FRAMES))
    small = max(large, BLOCKS * classes.sparkSession.sparkContext.defaultParallelism)
    blocks = [scratch.table(own.repartition(n).mapInArrow(block_of(kind), schema), "blocks") for n in (small, large)]
    scratch.drop(own)
    one = blocks[0].repartitionById(small, F.col("i")).select(*(F.col(c).alias(f"{c}_1") for c in names))
    two = blocks[1].select(*(F.col(c).alias(f"{c}_2") for c in names)).hint("shuffle_replicate_nl")
    return one.crossJoin(two).mapInArrow(product_rows(run, kind, strict), FOUND)


def numbered_rows(codes: np.ndarray, number: np.ndarray, kind):
    """(video_id, d, codes) with the numbers of codes as bytes; null is one more than the last."""

    def rows(batches):
        for rb in batches:
            flat = rb.column(2).flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            x = number[np.minimum(np.searchsorted(codes, flat.fill_null(0).to_numpy().view(np.uint64)), len(codes) - 1)].astype(kind)
            x[null] = number.max() + 1
            ends = np.r_[0, np.cumsum(pc.list_value_length(rb.column(2)).to_numpy())] * x.itemsize
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.Array.from_buffers(pa.binary(), rb.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])], ["video_id", "d", "codes"])

    return rows


def block_of(kind):
    """Rows (i, d, size, codes, many, ids) of packed units in order of size; i is the number of the task."""

    def block(held):
        d, codes, ids = (pa.concat_arrays([rb.column(k) for rb in held]) for k in range(3))
        size = pc.binary_length(codes).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
        many = pc.list_value_length(ids).to_numpy().astype(np.int64)
        order = np.argsort(size, kind="stable")
        codes, ids = np.frombuffer(b"".join(codes.to_pylist()), kind), ids.flatten().to_numpy()
        ordered = lambda x, k: x[ranges((np.cumsum(k) - k)[order], k[order])]
        row = (d.to_numpy()[order], size[order], ordered(codes, size), many[order], ordered(ids, many))
        cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row)]
        return pa.RecordBatch.from_arrays(cols, ["i", "d", "size", "codes", "many", "ids"])

    def rows(batches):
        held, n = [], 0
        for rb in batches:
            held.append(rb)
            n += pc.sum(pc.binary_length(rb.column(1))).as_py() or 0
            if n >= 2 * FRAMES:
                yield block(held)
                held, n = [], 0
        if sum(rb.num_rows for rb in held):
            yield block(held)

    return rows


def product_rows(run, kind, strict: bool):
    """Pairs of members of rows of two blocks; run(one, two) gives places in the two, n, start and hits."""

    def side(row):
        d, size, codes, many, ids = (np.frombuffer(x, t) for x, t in zip(row, (np.float64, np.int64, kind, np.int64, np.int64), strict=True))
        return {"d": d, "size": size, "first": np.cumsum(size) - size, "codes": codes, "many": many, "at": np.cumsum(many) - many, "ids": ids}

    def rows(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                row = [c[k].as_buffer() for c in rb.columns]
                one, two = side(row[:5]), side(row[5:])
                for found in run(one, two):
                    yield from member_pairs(one, two, *found, strict=strict)

    return rows


def best_alignments(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, n: np.ndarray, m: np.ndarray, t: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hits) of the best alignment of a[fa : fa + n] in b[fb : fb + m] for each pair; n <= m."""
    grid = (m - n) // step + 1
    out = np.zeros((2, len(n)), np.int64)
    done = np.cumsum(grid)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - grid[lo] + ALIGNMENTS, "right")))
        pair, s = np.repeat(np.arange(lo, hi), grid[lo:hi]), step * ranges(np.zeros(hi - lo, np.int64), grid[lo:hi])
        hits, long = np.zeros(len(pair), np.int64), np.cumsum(n[pair])
        at = 0
        while at < len(pair):
            end = max(at + 1, int(np.searchsorted(long, long[at] - n[pair[at]] + COMPARED, "right")))
            row = pair[at:end]
            agree = np.bitwise_count(a[ranges(fa[row], n[row])] ^ b[ranges(fb[row] + s[at:end], n[row])]) <= t
            hits[at:end] = np.add.reduceat(agree, np.cumsum(n[row]) - n[row], dtype=np.int64)
            at = end
        first = np.cumsum(grid[lo:hi]) - grid[lo:hi]
        top = np.maximum.reduceat(hits, first)
        # The first row of its pair that has the pair's maximum.
        ok = np.flatnonzero(hits == top[pair - lo])
        new = np.r_[True, pair[ok][1:] != pair[ok][:-1]]
        out[0, lo:hi], out[1, lo:hi] = s[ok[new]], top
        lo = hi
    return out[0], out[1]


def best_rows(t: int, step: int, least: float):
    """The pairs whose best alignment reaches a confidence, with n, start and hits of it."""

    def run(one, two, p, q):
        n, m = one["size"][p], two["size"][q]
        on = np.flatnonzero(n <= m)
        p, q, n, m = p[on], q[on], n[on], m[on]
        start, hits = best_alignments(one["codes"], two["codes"], one["first"][p], two["first"][q], n, m, t, step)
        on = np.flatnonzero(hits / n >= least)
        return p[on], q[on], n[on], start[on], hits[on]

    return run


def member_rows():
    """All pairs."""

    def run(one, two, p, q):
        none = np.zeros(len(p), np.int64)
        return p, q, none, none, none

    return run


def packed(side: list) -> dict[str, np.ndarray]:
    """Columns of the units of a block in the order of their ids; `first` and `at` are where their codes and members begin."""
    x, d, size, codes, many, ids = (np.concatenate(c) for c in zip(*side, strict=True))
    order = np.argsort(x)
    starts = lambda k: (np.cumsum(k) - k)[order]
    return {"x": x[order], "d": d[order], "size": size[order], "first": starts(size), "codes": codes, "many": many[order], "at": starts(many), "ids": ids}


def member_pairs(one: dict, two: dict, p: np.ndarray, q: np.ndarray, *more: np.ndarray, strict: bool = False):
    """Batches of the pairs of members of units. Of one duration, the lesser id is the shorter one; strict: such pairs go."""
    lo, total = 0, np.cumsum(one["many"][p] * two["many"][q])
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + OUT, "right")))
        a, b = p[lo:hi], q[lo:hi]
        size = one["many"][a] * two["many"][b]
        k, row = ranges(np.zeros(hi - lo, np.int64), size), np.repeat(np.arange(hi - lo), size)
        wide = two["many"][b][row]
        x, y = one["ids"][one["at"][a][row] + k // wide], two["ids"][two["at"][b][row] + k % wide]
        on = np.flatnonzero((one["d"][a] < two["d"][b])[row] | (not strict) & (one["d"][a] == two["d"][b])[row] & (x < y))
        row = row[on]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[on], y[on], one["d"][a][row], two["d"][b][row], *(c[lo:hi][row] for c in more))], ["short_id", "long_id", "short_duration", "long_duration", "n", "start", "hits"])
        lo = hi


def block_rows(run):
    """Pairs of members of rows (i, j, kind, x, y, d, codes, ids) that come sorted by block pair and kind: shorter units, longer ones, pairs of them.

    run(one, two, p, q) takes pairs of places in the two blocks and gives those that are left, with n, start and hits. Of one
    duration the lesser id is the shorter one.
    """

    def flat(c, kind):
        return pc.list_value_length(c).to_numpy().astype(np.int64), c.flatten().to_numpy().view(kind)

    def rows(batches):
        key, sides, ready = None, ([], []), None
        for rb in batches:
            i, j, kind = (rb.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(kind) != 0)]) if rb.num_rows else []
            for lo, hi in zip(cut, [*cut[1:], rb.num_rows], strict=True):
                part = rb.slice(lo, hi - lo)
                if (i[lo], j[lo]) != key:
                    key, sides, ready = (i[lo], j[lo]), ([], []), None
                x = part.column(3).to_numpy()
                if kind[lo] < 2:
                    sides[kind[lo]].append((x, part.column(5).to_numpy(), *flat(part.column(6), np.uint64), *flat(part.column(7), np.int64)))
                    continue
                if ready is None:
                    ready = [packed(side) for side in sides]
                one, two = ready
                yield from member_pairs(one, two, *run(one, two, np.searchsorted(one["x"], x), np.searchsorted(two["x"], part.column(4).to_numpy())))

    return rows


def matched(best: DataFrame, p: MatchParams, more: tuple[str, ...] = ()) -> DataFrame:
    return best.where(F.col("confidence") >= p.min_confidence).select("short_id", "long_id", match_type().alias("match_type"), "confidence", *more)


def telling(frames: DataFrame, videos: DataFrame, near: DataFrame, min_confidence: float) -> DataFrame:
    """(video_id, frame_idx, h) of the frames by which a video can be found as the shorter one of a match.

    Of n frames at least c * n agree on the diagonal of a match, so of any n - ceil(c * n) + 1 one does. Those with the fewest
    frames near them are taken: a frame that very many videos hold, black or a title, makes no pairs unless most of the video is such.
    """
    rate = near.join(frames.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("k")), "h2").groupBy(F.col("h1").alias("h")).agg(F.sum("k").alias("near"))
    return rarest(frames, videos, rate, min_confidence).drop("near")


def rarest(frames: DataFrame, videos: DataFrame, rate: DataFrame, min_confidence: float) -> DataFrame:
    """The same from the number of frames near each code (h, near), which is kept. Whatever it is, no match is lost."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("near", "frame_idx"))
    # A little too low a bound takes a frame too many, which does no harm.
    enough = F.col("n_frames") - F.ceil(F.col("n_frames") * min_confidence - 1e-6) + 1
    ranked = frames.select("video_id", "frame_idx", "h").join(rate, "h").withColumn("place", place)
    return ranked.join(videos.select(F.col("id").alias("video_id"), "n_frames"), "video_id").where(F.col("place") <= enough).select("video_id", "frame_idx", "h", "near")


def starts(frames: DataFrame, videos: DataFrame, p: MatchParams, comparisons: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(a, b, short_id, long_id, short_duration, long_duration, n, start): the alignments on the step grid that a telling frame
    votes for, of pairs that pass the gates and that no comparison has recorded. Every alignment that reaches min_confidence is among them."""
    near = near_codes(frames, p.threshold) if near is None else near
    v = videos.select("id", duration().alias("d"), "n_frames")
    side = lambda x, ds, ns, i: v.select(F.col("id").alias(x), F.col("d").alias(ds), F.col("n_frames").alias(ns)).withColumnRenamed(x, i)
    one = telling(frames, videos, near, p.min_confidence).join(side("x", "short_duration", "n", "video_id"), "video_id").where(F.col("short_duration") >= p.window)
    one = one.select(F.col("video_id").alias("short_id"), F.col("frame_idx").alias("i"), F.col("h").alias("h1"), "short_duration", "n")
    two = frames.select("video_id", "frame_idx", "h").join(side("x", "long_duration", "m", "video_id"), "video_id")
    two = two.select(F.col("video_id").alias("long_id"), F.col("frame_idx").alias("j"), F.col("h").alias("h2"), "long_duration", "m")
    met = spread_join(one.join(near.select("h1", "h2"), "h1").drop("h1"), two).withColumn("start", F.col("j") - F.col("i"))
    shorter = "short_id <> long_id and (short_duration < long_duration" + ("" if p.filter_length else " or short_duration = long_duration and short_id < long_id") + ")"
    met = met.where(shorter).where((F.col("start") >= 0) & (F.col("start") <= F.col("m") - F.col("n")) & (F.col("start") % p.frame_step == 0))
    met = met.select(F.least("short_id", "long_id").alias("a"), F.greatest("short_id", "long_id").alias("b"), "short_id", "long_id", "short_duration", "long_duration", "n", "start").distinct()
    return met if comparisons is None else uncompared(met, comparisons)


def sequences(frames: DataFrame) -> DataFrame:
    """(video_id, codes): the codes of each video in order."""
    whole = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "h"))).alias("f"))
    return whole.select("video_id", F.transform("f", lambda x: x["h"]).alias("codes"))


def score(tested: DataFrame, frames: DataFrame, threshold: int) -> DataFrame:
    """tested with `hits`: frames of the shorter video that agree with those of the longer one from `start` on. Ordinals have no gaps."""
    codes = Scratch(frames.sparkSession, "match").table(sequences(frames), "codes")
    both = tested.join(codes.select(F.col("video_id").alias("short_id"), F.col("codes").alias("one")), "short_id").join(codes.select(F.col("video_id").alias("long_id"), F.col("codes").alias("two")), "long_id")
    far = F.zip_with("one", F.slice("two", (F.col("start") + 1).cast("int"), F.size("one")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return both.select(*tested.columns, F.size(F.filter(far, lambda d: d <= threshold)).cast("long").alias("hits"))


def best_of(scores: DataFrame) -> DataFrame:
    """One row a pair: start and hits of the best alignment, ties to the first one, and confidence."""
    top = F.max(F.struct("hits", (-F.col("start")).alias("minus"))).alias("best")
    best = scores.groupBy("a", "b", "short_id", "long_id", "short_duration", "long_duration", "n").agg(top)
    return best.select("a", "b", "short_id", "long_id", "short_duration", "long_duration", (-F.col("best.minus")).alias("start"), F.col("best.hits").alias("hits"), (F.col("best.hits") / F.col("n")).alias("confidence"))


def diagonals(frames: DataFrame, videos: DataFrame, threshold: int, step: int, where: str = "true") -> DataFrame:
    """(a, b, start, hits): agreeing frames of each pair on each diagonal that the step grid tests; start null: on all others.

    Durations and lengths travel with the frames, so gates (`where` on d_a, d_b) and the grid act on frame pairs
    as they arise and only counts are shuffled.
    """
    known = videos.select(F.col("id").alias("video_id"), duration().alias("d"), F.col("n_frames").alias("n"))
    fp = frame_pairs(frames.select("video_id", "frame_idx", "h").join(known, "video_id"), threshold, ("d", "n")).where(where)
    a_short = F.col("d_a") <= F.col("d_b")
    start = F.when(a_short, F.col("ib") - F.col("ia")).otherwise(F.col("ia") - F.col("ib"))
    last = F.when(a_short, F.col("n_b") - F.col("n_a")).otherwise(F.col("n_a") - F.col("n_b"))
    rows = fp.select("va", "vb", start.alias("start"), last.alias("last"))
    fits = (F.col("start") >= 0) & (F.col("start") <= F.col("last")) & (F.col("start") % step == 0)
    return rows.groupBy(F.col("va").alias("a"), F.col("vb").alias("b"), F.when(fits, F.col("start")).alias("start")).agg(F.count("*").alias("hits"))


def scored(counts: DataFrame, videos: DataFrame) -> DataFrame:
    """Oriented pairs of diagonals' counts with `start`, `hits` of the best (ties to the first, null without one) and confidence."""
    best = F.max(F.when(F.col("start").isNotNull(), F.struct("hits", (-F.col("start")).alias("minus"))))
    top = counts.groupBy("a", "b").agg(best.alias("best")).select("a", "b", (-F.col("best.minus")).alias("start"), F.col("best.hits").alias("hits"))
    return orient(top, videos).withColumn("confidence", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)))


def best_diagonals(frames: DataFrame, videos: DataFrame, threshold: int, step: int) -> DataFrame:
    """short_id, long_id, short_duration, long_duration, n, start, hits, confidence: as `scored` of `diagonals`, counted in blocks of videos, so
    neither frame pairs nor diagonals are written or shuffled."""
    v = videos.select("id", duration().alias("d"), "n_frames")
    found = pair_blocks.pairs_of_blocks(frames, threshold, pair_blocks.scored_rows(step), pair_blocks.SCORED, v)
    return found.withColumn("confidence", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)))


def oriented_candidates(frames: DataFrame, videos: DataFrame, threshold: int) -> DataFrame:
    """short_id, long_id, short_duration, long_duration of the candidate pairs, as `orient` gives them. Durations travel with the blocks, so pairs meet no other table."""
    v = videos.select("id", duration().alias("d"), "n_frames")
    found = pair_blocks.pairs_of_blocks(frames, threshold, pair_blocks.candidate_rows(True), "a long, b long, d_a double, d_b double", v)
    s = F.col("d_a") <= F.col("d_b")
    pick = lambda x, y, name: F.when(s, F.col(x)).otherwise(F.col(y)).alias(name)
    return found.select(pick("a", "b", "short_id"), pick("b", "a", "long_id"), pick("d_a", "d_b", "short_duration"), pick("d_b", "d_a", "long_duration"))


def compare(frames: DataFrame, videos: DataFrame, p: MatchParams, comparisons: DataFrame | None = None) -> DataFrame:
    """Eligible pairs with a confidence. Gates come before the frame pairs are scored."""
    where = f"least(d_a, d_b) >= {float(p.window)!r}" + (" and d_a <> d_b" if p.filter_length else "")
    counts = diagonals(frames, videos, p.threshold, p.frame_step, where)
    return scored(counts if comparisons is None else uncompared(counts, comparisons), videos)
