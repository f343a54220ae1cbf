"""WARC archives in seekable Zstandard bundles.

Each page becomes a WARC record; records are grouped into frames that decompress alone, and a bundle ends with the seekable format's table
of frame sizes in a skippable frame.  An index maps a record's id to its bundle, frame and place within the frame.  Of records with equal
payloads of at least `LEAST_SHARED` bytes the one with the least page_id carries the payload, the others are revisits.

Bundles are rows (bundle, bytes) of a Parquet table in the shared folder, so a lost executor or a retried task leaves no half-written
archive and readers need Spark's file systems only; `export` writes them as files.  Digests are grouped with partial aggregation; only
digests that repeat are joined back, and adaptive execution splits the join where one payload is very common.  A task holds one bundle
(`BUNDLE_BYTES`) and one frame at a time.

Nulls: a null html is an empty payload, a null url leaves the target out; pages with a null page_id never are the carrier of others unless
all are null, then each is a response.  A page_id that is repeated with equal payload is a response each time.  Empty tables give an empty
archive.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, slices

LEAST_SHARED = 100
FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 4 << 20
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

BUNDLE_SCHEMA = "bundle string, bytes binary, records array<struct<page_id:bigint,record_id:string,frame:int,offset:int,length:int>>"
_RECORDS = pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response or revisit record, closed by two line ends.  A revisit keeps the HTTP head, which tells the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundler:
    """Collects records into frames and frames into a bundle."""

    def __init__(self):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.frames: list[tuple[bytes, int]] = []
        self.open, self.records, self.size = bytearray(), [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > FRAME_BYTES:
            self.close_frame()
        self.records.append({"page_id": page_id, "record_id": record_id(page_id), "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record

    def close_frame(self) -> None:
        if self.open:
            self.frames.append((self.compress(bytes(self.open)), len(self.open)))
            self.size += len(self.frames[-1][0])
            self.open = bytearray()

    def bundle(self) -> dict:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        whole = b"".join(f for f, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        done = {"bundle": uuid.uuid4().hex, "bytes": whole, "records": self.records}
        self.frames, self.records, self.size = [], [], 0
        return done


class BundleReader:
    """Random access to a bundle's frames by its footer."""

    def __init__(self, whole: bytes):
        import zstandard

        self.whole, self.decompress = whole, zstandard.ZstdDecompressor().decompress
        count, _, magic = struct.unpack("<IBI", whole[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        start = len(whole) - 9 - 8 * count
        self.places, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", whole, start + 8 * k)
            self.places.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.places[k]
            self.last = (k, self.decompress(self.whole[at : at + packed], max_output_size=plain))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: the least page_id of an equal long payload, null for a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    first = rows.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = rows.join(first.where("copies > 1").select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Write pages as bundles (with their index) to the Parquet table at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Bundler()

        def out() -> pa.RecordBatch:
            b = made.bundle()
            return pa.RecordBatch.from_pydict({"bundle": [b["bundle"]], "bytes": pa.array([b["bytes"]], pa.binary()), "records": pa.array([b["records"]], _RECORDS)})

        for batch in slices(batches):
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                made.add(page_id, warc_record(page_id, url, html.encode(), digest, refers_to))
                if made.size >= BUNDLE_BYTES:
                    yield out()
        if made.records:
            yield out()

    with_originals(pages).mapInArrow(run, BUNDLE_SCHEMA).write.parquet(path)


def read_archive(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, found through index and seek table: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A response's payload is digested anew; one that doesn't fit its header raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows = BundleReader(whole), []
                for r in records:
                    headers, block = parse_record(reader.record(r["frame"], r["offset"], r["length"]))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if headers["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload isn't what its header says")
                    at = headers.get("WARC-Refers-To")
                    rows.append((r["page_id"], size, digest, headers["WARC-Type"], int(at[10:-1]) if at else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4], pa.int64())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return bundles.select("bytes", "records").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> int:
    """Write every bundle as <bundle>.warc.zst to a folder that the driver can open; returns how many.  Bundles arrive one at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for name, whole in bundles.select("bundle", "bytes").toLocalIterator():
        with open(os.path.join(folder, f"{name}.warc.zst"), "wb") as out:
            out.write(whole)
        n += 1
    return n


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to a new archive in the shared folder and read all records back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark.read.schema(BUNDLE_SCHEMA).parquet(path))


ORACLE = """
with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d, strlen(coalesce(html, '')) n from pages),
f as (select d, min(page_id) first from p where n >= 100 group by d)
select page_id, n::bigint payload_bytes, p.d payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end refers_to from p left join f on p.d = f.d
"""
