"""MinHash near-duplicate classes by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

Round i hashes every element to one of T bins with a value; a bin keeps the least value of the first
round that reached it. After T rounds a bin that is still empty takes the least value over all
elements in a round of its own, so every coordinate is filled, and coordinates of two sets agree with
the probability of their Jaccard similarity, with Chernoff-type concentration. Bands of the
coordinates give buckets; links are confirmed on the full shingle sets.

Null or wordless text: an empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Rows that share a doc_id are one document. A null doc_id takes no part
in links (component null, kept). Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .common import Scratch, documents, ids_of, text_steps
from .linking import link_classes

U64 = np.uint64
SHINGLE, PERCENT = 5, 85
BINS = 256
#: Probability at most with which the bands miss a pair at the threshold.
MISS = 4e-6
SEED, ADD = w.seeds(2 * BINS, 101) | U64(1), w.seeds(2 * BINS, 202)
KEY, BAND = w.seeds(BINS, 303) | U64(1), w.seeds(BINS, 404)
FULL = U64(w.MASK)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which as many bands as fit miss a pair at the threshold with probability MISS or
    less; 36 bands of 7 at 85 (9e-7), 42 of 6 at 80 (3e-6)."""
    return next((BINS // r, r) for r in range(BINS, 0, -1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISS or r == 1)


def least_agreeing(percent: int) -> int:
    """Equal four-bit coordinates five standard deviations under those of a pair at the threshold; 191 of 256 at 85, 176 at 80."""
    p = percent / 100
    return round(BINS * (p + (1 - p) / 16) - 5 * (BINS * p * (1 - p)) ** 0.5)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, one text after the other; sizes of the sets."""
    data = w.LOWER[data]
    starts, ends, first = w.spans(data, off)
    n = np.diff(first)
    hashes = w.word_hashes(data, starts, ends)
    per = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = w.ranges(first[:-1], per)
    whole = np.repeat(n >= size, per)
    runs = np.empty(len(at), U64)
    runs[whole] = w.run_hashes(hashes, at[whole], size)
    runs[~whole] = w.short_hashes(hashes, first[:-1][(n > 0) & (n < size)], n[(n > 0) & (n < size)])
    cut = np.cumsum(per)[:-1]
    sets = [np.unique(x) for x in np.split(runs, cut)]
    return (np.concatenate(sets) if sets else runs), np.array([len(x) for x in sets], np.int64)


def sketches(values: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of `bins` coordinates for every non-empty set; empty sets get zeros."""
    n = len(sizes)
    out = np.full(n * bins, FULL, U64)
    done = np.zeros(n * bins, bool)
    done.reshape(n, bins)[sizes == 0] = True
    owner = np.repeat(np.arange(n), sizes)
    live, rows = values, owner
    shift = U64(64 - (bins - 1).bit_length())
    for i in range(bins):
        if not len(live):
            break
        x = w.mix(live * SEED[i] + ADD[i])
        slot = rows * bins + (x >> shift).astype(np.int64)
        free = ~done[slot]
        np.minimum.at(out, slot[free], x[free])
        done[slot] = True
        open_rows = ~done.reshape(n, bins).all(1)
        if not open_rows.all():
            keep = open_rows[rows]
            live, rows = live[keep], rows[keep]
    for j in range(bins):
        need = ~done.reshape(n, bins)[:, j]
        if need.any():
            keep = need[rows]
            np.minimum.at(out, rows[keep] * bins + j, w.mix(live[keep] * SEED[bins + j] + ADD[bins + j]))
    out = out.reshape(n, bins)
    out[sizes == 0] = 0
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (sketch[:, : bands * rows].reshape(len(sketch), bands, rows) * KEY[:rows]).sum(2, dtype=U64)
        return w.mix(x + BAND[:bands]).view(np.int64)


SIGNED = "doc_id long, n_shingles long, digest binary, sketch array<long>, keys array<long>"
SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def rows_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def sign(ids: pa.Array, values: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> pa.RecordBatch:
    sk = sketches(values, sizes)
    keys = band_keys(sk, bands, rows)
    raw, ends = values.tobytes(), np.cumsum(sizes) * 8
    digest = [hashlib.blake2b(raw[e - 8 * s : e], digest_size=16).digest() if s else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    low = ((sk & U64(15)).reshape(len(sk), -1, 16) << (U64(4) * np.arange(16, dtype=U64))).sum(2, dtype=U64).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(sizes), pa.array(digest, pa.binary()), rows_of(low), rows_of(keys)],
        schema=SIGNED_ARROW,
    )


def signatures(bands: int, rows: int):
    def run(batches):
        for rb in batches:
            for lo, hi, data, off in text_steps(rb):
                yield sign(ids_of(rb, lo, hi), *shingle_sets(data, off), bands, rows)

    return run


def set_payloads(batches):
    for rb in batches:
        for lo, hi, data, off in text_steps(rb):
            values, sizes = shingle_sets(data, off)
            raw, ends = values.tobytes(), np.cumsum(sizes) * 8
            yield pa.RecordBatch.from_arrays([ids_of(rb, lo, hi).cast(pa.int64()), pa.array([raw[e - 8 * s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())], ["id", "payload"])


def similar_sets(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def classes(signed: DataFrame, columns: list[str], link: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(doc_id, component_id) where they differ, of `signed` (row, doc_id, digest, *columns; a written table); equal digests count as one node. link(nodes of id, *columns) gives (node, label)."""
    slim = signed.select("row", "doc_id", "digest").where("doc_id is not null and digest is not null")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("row", "doc_id").alias("first_row"), F.count("*").alias("n"))
    first = scratch.table(first, "first")
    # Most digests occur once, so the few later copies are taken out rather than the many first ones picked.
    copies = slim.join(first.where("n > 1").select("digest", "first_row"), "digest").where("row <> first_row").select("row")
    copies = scratch.table(copies, "copies")
    unique = signed.where("doc_id is not null and digest is not null").join(copies, "row", "left_anti")
    nodes = unique.select(F.col("doc_id").alias("id"), *columns)
    labels = link(scratch.table(nodes, "nodes"))
    member = first.join(labels.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or label is not null").select("digest", F.coalesce("label", "id").alias("component_id"))
    return slim.select("doc_id", "digest").join(member, "digest").where("doc_id <> component_id").select("doc_id", "component_id").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document. percent: similarity from which on documents link."""
    scratch = Scratch(spark, "minhash")
    docs = documents(docs)
    signed = scratch.table(docs.mapInArrow(signatures(*bands_for(percent)), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")

    def payloads(ids: DataFrame) -> DataFrame:
        return docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(set_payloads, "id long, payload binary")

    def link(nodes: DataFrame) -> DataFrame:
        return link_classes(nodes, payloads, partial(similar_sets, percent=percent), percent, least_agreeing(percent), scratch)

    input_ = signed.select("row", "doc_id", "digest", F.col("n_shingles").alias("size"), "sketch", "keys")
    found = scratch.table(classes(input_, ["size", "sketch", "keys"], link, scratch), "moved")
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
