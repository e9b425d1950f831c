"""Best-fit packing into sequences of a fixed length, by hierarchical residual packing.

Each partition tokenizes its documents, cuts those longer than a sequence, and packs the pieces best
fit, longest first. Nearly full bins are done; underfull bins go up as items, whole, and are packed
again with those of several other partitions, level by level, until one partition is left or a level no
longer lowers their number. A task holds the items of its partition at most MOST_ITEMS at a time.

A null or empty text is its end id alone, one token. Repeated rows are packed each. Extra columns are
ignored. Sequence ids are arbitrary; offsets in a sequence are gapless from 0.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .tokens import CACHE_ENTRIES, chunks, default_path

LENGTH = 2048
#: A bin with no more than this much room left is done before the last level.
NEARLY = 2
#: Items that one task packs at once, and partitions' worth of bins that meet on each level.
MOST_ITEMS, FAN_IN = 400_000, 8

PIECES = "array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>>"
BINS = f"used int, pieces {PIECES}"
PIECE_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
BINS_ARROW = pa.schema([("used", pa.int32()), ("pieces", pa.list_(PIECE_ARROW))])


class Fit:
    """Open bins by room left; the tightest bin with room for an item is found in a bit set."""

    def __init__(self, length: int):
        self.rooms: list[list[list]] = [[] for _ in range(length + 1)]
        self.bits, self.length = 0, length

    def add(self, size: int, pieces: list) -> None:
        up = self.bits >> size
        if up and size:
            room = size + (up & -up).bit_length() - 1
            bin_ = self.rooms[room].pop()
            if not self.rooms[room]:
                self.bits &= ~(1 << room)
            bin_.extend(pieces)
        else:
            room, bin_ = self.length, list(pieces)
        room -= size
        self.rooms[room].append(bin_)
        self.bits |= 1 << room

    def bins(self):
        for room, bins in enumerate(self.rooms):
            for b in bins:
                yield self.length - room, b


def best_fit(items: list[tuple[int, list]], length: int = LENGTH) -> list[tuple[int, list]]:
    """(used, pieces) of bins that hold the items (size, pieces), longest first; ties in the order of the first piece."""
    fit = Fit(length)
    for size, pieces in sorted(items, key=lambda x: -x[0]):
        fit.add(size, pieces)
    return list(fit.bins())


def cut(doc_id: int | None, ids: bytes, length: int = LENGTH) -> list[tuple]:
    """Pieces of a document; of a longer one all have `length` ids but the first, which may be shorter."""
    n = len(ids) // 4
    head = n % length or length if n > length else n
    edges = [0, *range(head, n + 1, length)]
    return [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def bin_batches(bins):
    rows = []
    for used, pieces in bins:
        rows.append({"used": used, "pieces": [dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), p, strict=True)) for p in pieces]})
        if len(rows) == 2000:
            yield pa.RecordBatch.from_pylist(rows, BINS_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, BINS_ARROW)


def pack_documents(path: str, length: int, cache_entries: int):
    def run(batches):
        cache, items = chunks(path, cache_entries), []
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                for p in cut(doc_id, cache.ids(text.as_py()), length):
                    items.append((p[3], [p]))
            if len(items) >= MOST_ITEMS:
                yield from bin_batches(best_fit(items, length))
                items = []
        yield from bin_batches(best_fit(items, length))

    return run


def pack_bins(length: int):
    def run(batches):
        items = []
        for rb in batches:
            for used, pieces in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                items.append((used, [tuple(p.values()) for p in pieces]))
            if len(items) >= MOST_ITEMS:
                yield from bin_batches(best_fit(items, length))
                items = []
        yield from bin_batches(best_fit(items, length))

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. cache_entries: encoded chunks that a worker keeps."""
    scratch = Scratch(spark, "packing")
    level = scratch.table(documents(docs).mapInArrow(pack_documents(path or default_path(), length, cache_entries), BINS), "level")
    full = f"used > {length - NEARLY}"
    done, tasks, was = [level.where(full)], int(spark.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        # A bin that is more than half full only takes smaller ones, so bins of all sizes are dealt out evenly.
        open_ = level.where(f"not ({full})")
        left = open_.count()
        tasks = max(1, -(-left // MOST_ITEMS), tasks // FAN_IN)
        if not left or was is not None and (was[1] == 1 or tasks >= was[1] and left > 0.99 * was[0]):
            done.append(open_)
            break
        was = (left, tasks)
        level = scratch.table(open_.repartition(tasks).mapInArrow(pack_bins(length), BINS), "level")
        done.append(level.where(full))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    bins = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    return bins.mapInArrow(offsets, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def offsets(batches):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    for rb in batches:
        rows = []
        for pieces, seq in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
            at = 0
            for p in pieces:
                rows.append((*p.values(), seq, at))
                at += p["length"]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
