"""Token ids in length-delimited binary records with a separate offset index.

A record is framed as: length (unsigned 64-bit, little-endian), masked checksum of the length, payload,
masked checksum of the payload. A checksum is CRC-32; masked: rotated right by 15 bits plus a constant,
so that a checksum of bytes that hold checksums stays sound. The payload is a sequence: flags, doc_id,
number of ids, ids in 16 bits if all fit, else in 32. The index of a shard has for each record its byte
offset, its bytes and the ids before it in the shard, so a reader can shuffle records without a scan.

Shards hold documents in ascending doc_id order (null first). Null text is empty: the end id alone.
Repeated rows are records each. Extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents
from .shards import partition_number, reader, writer
from .tokens import chunks, default_path

HEAD = struct.Struct("<BqQ")
SHARD_BYTES = 256 << 20
MOST_TASKS = 50_000
INDEX_MAGIC = b"LDRINDEX"
MANIFEST = "shard string, records long, tokens long, bytes long"


class Corrupt(ValueError):
    """A frame, checksum or index that doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frames(stream):
    """Payloads of a stream of frames; raises Corrupt at a wrong checksum or a cut frame."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise Corrupt("length")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
            raise Corrupt("payload")
        yield body[:size]


def encode_sequence(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return HEAD.pack((doc_id is None) | wide << 1, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def decode_sequence(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, HEAD.size)
    return (None if flags & 1 else doc_id), ids.astype("<u4")


class ShardWriter:
    """One shard and its index."""

    def __init__(self, uri: str):
        self.uri, self.open = uri, writer(uri)
        self.out, self.index, self.at, self.tokens = self.open.__enter__(), [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = frame(encode_sequence(doc_id, ids))
        self.out.write(data)
        self.index.append((self.at, len(data), self.tokens))
        self.at += len(data)
        self.tokens += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        self.open.__exit__(None, None, None)
        body = np.array(self.index, "<i8").reshape(-1, 3).tobytes()
        with writer(self.uri + ".idx") as out:
            out.write(INDEX_MAGIC + struct.pack("<QI", len(self.index), masked(body)) + body)
        return self.uri, len(self.index), self.tokens, self.at


def read_index(uri: str) -> np.ndarray:
    """Rows of (byte offset, bytes, ids before) of a shard."""
    with reader(uri + ".idx") as f:
        head, body = f.read(20), f.read()
    n, crc = struct.unpack("<QI", head[8:])
    if head[:8] != INDEX_MAGIC or len(body) != 24 * n or crc != masked(body):
        raise Corrupt("index")
    return np.frombuffer(body, "<i8").reshape(n, 3)


def read_record(stream, entry: np.ndarray) -> tuple[int | None, np.ndarray]:
    """The sequence at one index entry of an open, seekable shard."""
    stream.seek(int(entry[0]))
    import io

    return decode_sequence(next(read_frames(io.BytesIO(stream.read(int(entry[1]))))))


def write_shards(root: str, path: str, shard_bytes: int = SHARD_BYTES):
    def run(batches):
        cache, part, rows, shard = chunks(path), partition_number(), [], None
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                shard = shard or ShardWriter(f"{root}/part-{part:06d}-{len(rows):06d}.ldr")
                shard.add(doc_id, np.frombuffer(cache.ids(text.as_py()), "<u4"))
                if shard.at >= shard_bytes:
                    rows.append(shard.close())
                    shard = None
        if shard:
            rows.append(shard.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "records", "tokens", "bytes"), r, strict=True)) for r in rows], pa.schema([("shard", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_records(spark: SparkSession, docs: DataFrame, root: str, scratch: Scratch, path: str | None = None) -> DataFrame:
    """Writes shards under `root` in ascending doc_id order; the manifest: shard, records, tokens, bytes."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = documents(docs).repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return scratch.table(ordered.mapInArrow(write_shards(root, path or default_path()), MANIFEST), "manifest")


def read_shards(batches):
    """A row for each record: the sequence's checksum and the ids before it, from the frames and the index."""
    for rb in batches:
        for uri, base in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            index = read_index(uri)
            rows = []
            with reader(uri) as f:
                for payload in read_frames(f):
                    doc_id, ids = decode_sequence(payload)
                    rows.append((doc_id, base + int(index[len(rows), 2]), len(ids), zlib.crc32(ids.tobytes())))
            if len(rows) != len(index):
                raise Corrupt("index and shard differ")
            for lo in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 50_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read back from the files."""
    # One row per shard: a running sum over file metadata.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return shards.repartitionByRange(max(1, min(MOST_TASKS, manifest.count())), "shard").mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    scratch = Scratch(spark, "records")
    return read_records(spark, write_records(spark, docs, scratch.path("shards"), scratch, path))
