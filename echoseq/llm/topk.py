"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; each block of queries meets every block of candidates. A pass scores
every pair and counts scores by bin of each query's range; the counts of all blocks locate the bin
with the k-th best value, and the next pass refines that bin. When few scores are left above the bin's
lower edge, or bins hold one integer, a last pass keeps the scores at or above the edge and ties go to
the smaller id. Scores are integer inner products of floor(64 * x).

Vectors that are null, hold a null or non-finite component, or have another length than the most
common one take no part, nor does a null id. Candidates with the query's own id are left out. Other
repeated rows count each: a query row has a ranking of its own, also if its id repeats, and a repeated candidate
takes a rank each time. With fewer candidates than k all are returned. An empty
table gives none. Products are exact whatever the size of components; a score that 64 bits can't hold counts as
the largest number of its sign, 2**63 - 1, that they can.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K, EVERY, SCALE = 20, 20, 64.0
BLOCK, STEP, BINS = 4096, 256, 256
BLOCKS = "block long, n long, norm double, ids binary, vecs binary"
#: The largest score in size, and the norm from which on vectors are packed apart, since their products may exceed it.
TOP, HUGE = (1 << 63) - 1, float(1 << 30)


def vectors(rb: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(64 * x) of the vectors that take part."""
    ids, col = rb.column(0), rb.column(1)
    ok = ids.is_valid().to_numpy(zero_copy_only=False) & col.is_valid().to_numpy(zero_copy_only=False)
    ok &= np.diff(col.offsets.to_numpy()) == dim
    rows = np.flatnonzero(ok)
    flat = col.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float64())
    good = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(1) if dim else np.zeros(0, bool)
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good &= np.isfinite(x).all(1)
    return ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)[good], np.floor(SCALE * x[good])


def pack(dim: int, only: int | None = None):
    def run(batches):
        from .shards import partition_number

        ids, vecs, held, number = [], [], 0, partition_number() << 32

        def out():
            nonlocal number
            i, v = np.concatenate(ids), np.concatenate(vecs)
            huge = norms(v) >= HUGE
            cut = [np.flatnonzero(x)[lo : lo + BLOCK] for x in (~huge, huge) for lo in range(0, int(x.sum()), BLOCK)]
            for rows in cut:
                a, b = i[rows], v[rows]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(a)], pa.int64()), pa.array([float(norms(b).max())]), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["block", "n", "norm", "ids", "vecs"])

        for rb in batches:
            i, v = vectors(rb, dim)
            if only:
                i, v = i[i % only == 0], v[i % only == 0]
            ids.append(i)
            vecs.append(v)
            held += len(i)
            if held >= BLOCK:
                yield from out()
                ids, vecs, held = [], [], 0
        if held:
            yield from out()

    return run


def norms(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        top = np.abs(v).max(1, initial=0.0, keepdims=True)
        return (top * np.sqrt(((v / np.maximum(top, 1.0)) ** 2).sum(1, keepdims=True)))[:, 0]


def scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of at most `bound`; doubles hold them exactly below 2**53, 64-bit integers below 2**63, beyond that Python's do."""
    if bound < 2**52:
        return q @ c.T
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(c).T, -TOP, TOP).astype(np.int64)


def bins_of(s: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bins of scores; under the range -1. Scores over it were over it in the pass before and count as of its last bin."""
    if s.dtype.kind == "f":
        return np.clip(np.floor_divide(s - low[:, None], width[:, None]), -1, BINS - 1)
    # The difference of two 64-bit integers, exact as an unsigned one.
    far = (s - low[:, None]).view(np.uint64) // width[:, None].astype(np.uint64)
    return np.where(s < low[:, None], -1, np.minimum(far, np.uint64(BINS - 1)).astype(np.int64))


def pairs_of(rb: pa.RecordBatch, dim: int):
    """(query block, positions, ids, low, width, scores, candidate ids) for steps of queries of every joined row."""
    for r in rb.to_pylist():
        qi, ci = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["cids"], np.int64)
        q, c = np.frombuffer(r["vecs"]).reshape(-1, dim), np.frombuffer(r["cvecs"]).reshape(-1, dim)
        low, width = np.frombuffer(r["low"], np.int64), np.frombuffer(r["width"], np.int64)
        bound = r["norm"] * r["cnorm"]
        for lo in range(0, len(qi), STEP):
            s = slice(lo, lo + STEP)
            yield r["block"], np.arange(lo, min(lo + STEP, len(qi))), qi[s], low[s], width[s], scores(q[s], c, bound), ci


def top_counts(k: int, dim: int):
    """(block, pos, bin, n): counts by bin. Bins below a block's own k-th best can't hold the global one."""

    def run(batches):
        for rb in batches:
            for block, pos, qi, low, width, s, ci in pairs_of(rb, dim):
                b = bins_of(s, low, width)
                b[qi[:, None] == ci[None, :]] = -1
                if s.shape[1] > k:
                    edge = np.partition(b, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                else:
                    edge = np.zeros(len(qi))
                row, col = np.nonzero(b >= np.maximum(edge, 0)[:, None])
                key, n = np.unique(row * BINS + b[row, col].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(pos[key // BINS]), pa.array(key % BINS), pa.array(n.astype(np.int64))], ["block", "pos", "bin", "n"])

    return run


STATE = BLOCKS + ", low binary, width binary, open long"


def refine(k: int):
    def run(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        """The bin of every query's k-th best becomes its range; open: queries whose range is still wide and full."""
        if not len(q):
            return q
        low, width = (np.frombuffer(q[c].iloc[0], np.int64) for c in ("low", "width"))
        counts = np.zeros((len(low), BINS), np.int64)
        counts[h["pos"].to_numpy(), h["bin"].to_numpy()] = h["n"].to_numpy()
        total = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        hit = total >= k
        # The last bin from which on k scores are reached; without one there are fewer than k, and all stay.
        found = hit.any(1)
        at = np.where(found, BINS - 1 - np.argmax(hit[:, ::-1], axis=1), 0)
        left = total[np.arange(len(at)), at]
        low = np.where(found, low + at * width, low)
        is_open = found & (width > 1) & (left > 4 * k)
        width = np.maximum(1, -(-width // BINS))
        return q.assign(low=[low.tobytes()], width=[width.tobytes()], open=[int(is_open.sum())])

    return run


def start(norm: float, dim: int):
    def run(batches):
        for rb in batches:
            for r in rb.to_pylist():
                v = np.frombuffer(r["vecs"]).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    far = np.ceil(norms(v) * norm * (1 + 1e-9)) + 1
                bound = np.where(far < 2**62, far, 0).astype(np.int64)
                bound[far >= 2**62] = TOP
                width = bound // (BINS // 2) + 1
                yield pa.RecordBatch.from_pylist([r | {"low": (-bound).tobytes(), "width": width.tobytes(), "open": len(v)}])

    return run


def survivors(k: int, dim: int):
    """Scores at or above the query's edge, at most k of a pair of blocks, the best by score then id."""

    def run(batches):
        for rb in batches:
            for block, pos, qi, low, _, s, ci in pairs_of(rb, dim):
                ok = (s >= low[:, None]) & (qi[:, None] != ci[None, :])
                row, col = np.nonzero(ok)
                sc = s[row, col].astype(np.int64)
                order = np.lexsort((ci[col], -sc, row))
                row, col, sc = row[order], col[order], sc[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), block)), pa.array(pos[row[keep]]), pa.array(qi[row[keep]]), pa.array(ci[col[keep]]), pa.array(sc[keep])], ["block", "pos", "query_id", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score."""
    scratch = Scratch(spark, "topk")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    stats = rows.where("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).orderBy(F.desc("n"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if stats is None or not stats["dim"]:
        return spark.createDataFrame([], empty)
    dim, n, nq = stats["dim"], stats["n"], stats["q"]
    blocks = scratch.table(rows.coalesce(max(1, -(-n // BLOCK))).mapInArrow(pack(dim), BLOCKS) if n < 100 * BLOCK else rows.mapInArrow(pack(dim), BLOCKS), "blocks")
    norm = blocks.agg(F.max("norm")).first()[0]
    if norm is None:
        return spark.createDataFrame([], empty)
    asked = rows.where(F.col("vec_id") % every == 0).repartition(max(1, -(-nq // BLOCK)))
    state = scratch.table(asked.mapInArrow(pack(dim), BLOCKS).mapInArrow(start(norm, dim), STATE), "queries")
    groups = max(1, min(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cands = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.col("norm").alias("cnorm"), F.col("ids").alias("cids"), F.col("vecs").alias("cvecs"))

    def meet(state: DataFrame) -> DataFrame:
        q = state.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "block", "norm", "ids", "vecs", "low", "width")
        return cands.repartition(groups, "g").join(q.repartition(groups, "g"), "g")

    while True:
        counts = meet(state).mapInArrow(top_counts(k, dim), "block long, pos long, bin long, n long").groupBy("block", "pos", "bin").agg(F.sum("n").alias("n"))
        state = scratch.table(state.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(refine(k), STATE), "queries")
        if not state.agg(F.sum("open")).first()[0]:
            break
    found = meet(state).mapInArrow(survivors(k, dim), "block long, pos long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "pos").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
