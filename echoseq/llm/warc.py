"""Legacy archive converter: ARC versions 1 and 2 to WARC.

The version block of an ARC file names the version; each version has its own header line. A record's
declared length gives its end. The converter synthesises what WARC asks for and ARC lacks: a record
identifier (a name-based UUID of address, date, digest and place), an ISO timestamp, a type (warcinfo for the version block,
response, or revisit for a payload seen before) and digests of block and payload.

Null html is an empty payload; payloads under 100 bytes are never revisits. Of repeated page_ids with
equal payloads the first by page_id, then by place, is the response (null page_id last). White space
in an address is percent-encoded; a null address becomes a URN. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .shards import partition_number, reader, writer

LEAST_PAYLOAD = 100
SHARD_BYTES = 128 << 20
MOST_TASKS = 50_000
#: Fields of a header line by version, as the version block of the file spells them.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """A header line or a declared length that doesn't hold."""


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def arc_version_block(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 echoseq\n{' '.join(FIELDS[version])}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    line = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_header(line: bytes, names: list[str]) -> dict[str, str]:
    """Fields of a header line. Only the address may hold spaces, so the others are taken from the right."""
    parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not re.fullmatch(r"\d+", parts[-1]) or not re.fullmatch(r"\d{8,14}", parts[2]):
        raise BadArchive(f"header line: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def read_arc(stream):
    """Records of a plain ARC stream, the version block first."""
    line = stream.readline()
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise BadArchive("no version block")
    # The version is known only from the block; both versions end the line with the length.
    size = int(line.rsplit(b" ", 1)[1])
    body = stream.read(size)
    version = int(body.split(b" ", 1)[0])
    if version not in FIELDS or len(body) != size:
        raise BadArchive(f"version block: {body[:80]!r}")
    names = FIELDS[version]
    yield ArcRecord(parse_header(line, names) | {"version": str(version)}, body)
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        fields = parse_header(line, names)
        size = int(fields["Archive-length"])
        block = stream.read(size)
        if len(block) != size:
            raise BadArchive(f"cut record: {line[:200]!r}")
        yield ArcRecord(fields, block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and payload; a block without HTTP headers is all payload."""
    if block.startswith(b"HTTP/") and (at := block.find(b"\r\n\r\n")) >= 0:
        return block[: at + 4], block[at + 4 :]
    return b"", block


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {place}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, place: str, revisit_of: int | None = None, is_revisit: bool = False) -> bytes:
    """The WARC record of an ARC record. place: where in the archive it stood, which tells repeated captures apart."""
    f = record.fields
    date = f["Archive-date"]
    if f["URL"].startswith("filedesc://"):
        body = f"software: echoseq\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{f['version']}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f["URL"], date, "info", place)), ("WARC-Date", iso_date(date)), ("Content-Type", "application/warc-fields")], body)
    http, payload = split_http(record.block)
    digest = hashlib.sha256(payload).hexdigest()
    block = http if is_revisit else record.block
    kind = "application/http; msgtype=response" if http else f["Content-type"]
    headers = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(f["URL"], date, digest, place)), ("WARC-Date", iso_date(date)), ("WARC-Target-URI", f["URL"]), ("WARC-IP-Address", f["IP-address"]), ("Content-Type", kind), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if is_revisit:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", "" if revisit_of is None else str(revisit_of))]
    return warc_record(headers, block)


def read_warc(stream):
    """(headers, block) of the records of a plain WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise BadArchive(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            headers[k] = v
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise BadArchive("cut record")
        yield headers, block


def page_block(page_id: int | None, html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


def header_of(http: bytes, name: str) -> str:
    m = re.search(rf"^{name}: (.*)\r$".encode(), http, re.M)
    return m[1].decode() if m else ""


def write_arcs(root: str, date: str):
    """Legacy archives of (page_id, url, html), even partitions in version 1, odd ones in version 2."""

    def run(batches):
        part = partition_number()
        version, done, out, at, keep = 1 + part % 2, [], None, 0, None
        for rb in batches:
            for page_id, url, html in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), strict=True):
                if out is None:
                    name = f"{root}/part-{part:06d}-{len(done):06d}.arc.gz"
                    keep, at, n = writer(name), 0, 0
                    out = keep.__enter__()
                    data = gz(arc_version_block(name.rpartition("/")[2], date, version))
                    out.write(data)
                    at += len(data)
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
                body = html.as_py()
                data = gz(arc_record(version, address, date, page_block(page_id, body.encode() if body else b""), at, name.rpartition("/")[2]))
                out.write(data)
                at += len(data)
                n += 1
                if at >= SHARD_BYTES:
                    keep.__exit__(None, None, None)
                    done.append((name, n))
                    out = None
        if out is not None:
            keep.__exit__(None, None, None)
            done.append((name, n))
        yield pa.RecordBatch.from_pylist([{"shard": s, "records": k} for s, k in done], pa.schema([("shard", pa.string()), ("records", pa.int64())]))

    return run


def page_id_of(http: bytes) -> int | None:
    x = header_of(http, "X-Page-Id")
    return int(x) if x else None


def payload_digests(batches):
    for rb in batches:
        for shard in rb.column(0).to_pylist():
            rows = []
            with reader(shard) as raw, gzip.open(raw) as f:
                for n, r in enumerate(read_arc(f)):
                    if n:
                        http, payload = split_http(r.block)
                        rows.append({"shard": shard, "place": n, "page_id": page_id_of(http), "payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())]))


def convert_shards(root: str):
    """Converts ARC shards; `again` lists (place, refers_to) of the records that become revisits."""

    def run(batches):
        for rb in batches:
            for shard, again in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                revisits = {x["place"]: x["refers_to"] for x in again or []}
                name = shard.rpartition("/")[2].replace(".arc.gz", ".warc.gz")
                with reader(shard) as raw, gzip.open(raw) as f, writer(f"{root}/{name}") as out:
                    for n, r in enumerate(read_arc(f)):
                        out.write(gz(convert(r, f"{name}#{n}", revisits.get(n), n in revisits)))
                yield pa.RecordBatch.from_pydict({"shard": [f"{root}/{name}"]})

    return run


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_pages(batches):
    """Rows of the WARC shards; digests are checked against the payloads that are there."""
    for rb in batches:
        for shard in rb.column(0).to_pylist():
            rows = []
            with reader(shard) as raw, gzip.open(raw) as f:
                for h, block in read_warc(f):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(header_of(http, "Content-Length"))
                    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise BadArchive("payload digest")
                    to = h.get("X-Refers-To-Page")
                    rows.append({"page_id": page_id_of(http), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": int(to) if to else None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))


def spread(shards: DataFrame, tasks: int) -> DataFrame:
    """Shards in the order of their names, dealt evenly over tasks. A repartition by the shard itself would be dropped after a
    join on it, and what such a join leaves is joined into few tasks by the size of the manifest, not of the files."""
    return shards.repartitionByRange(tasks, "shard")


def archive(spark: SparkSession, pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """Writes pages as ARC, converts to WARC with revisits, reads back: one row per page."""
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    arcs = scratch.table(pages.mapInArrow(write_arcs(scratch.path("arc"), date), "shard string, records long"), "arcs")
    # A task a shard, up to a number that the scheduler bears.
    tasks = max(1, min(MOST_TASKS, arcs.count()))
    seen = scratch.table(spread(arcs.select("shard"), tasks).mapInArrow(payload_digests, "shard string, place long, page_id long, payload_bytes long, digest string"), "digests")
    long = seen.where(F.col("payload_bytes") >= LEAST_PAYLOAD)
    first = long.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "shard", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = long.join(first, "digest").where(~(F.col("first.shard").eqNullSafe(F.col("shard")) & F.col("first.place").eqNullSafe(F.col("place"))))
    again = again.groupBy("shard").agg(F.collect_list(F.struct("place", F.col("first.page_id").alias("refers_to"))).alias("again"))
    # Written first, so the range bounds don't take the join a second time.
    todo = scratch.table(arcs.select("shard").join(again, "shard", "left"), "todo")
    warcs = scratch.table(spread(todo, tasks).mapInArrow(convert_shards(scratch.path("warc")), "shard string"), "warcs")
    return spread(warcs, tasks).mapInArrow(read_pages, PAGES)
