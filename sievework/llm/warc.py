"""WARC archives as seekable Zstandard bundles.

Pages become WARC/1.1 records: the first of equal payloads (of at least ``MIN_REVISIT`` bytes) is a response, the
others are revisits that refer to it. Every task packs its records into independent Zstandard frames of about
``FRAME`` bytes and frames into bundles of about ``BUNDLE`` bytes; a bundle ends with a seek table in the seekable
format, so any Zstandard reader can stream it and a reader of one record fetches one frame. The index
(page_id -> bundle, frame offset, offset in the frame) is a Parquet table committed by Spark: bundles of attempts
that were lost are never in it, so a retried task leaves the archive whole.

Bundles go to the shared folder through the store's own client (local paths, HDFS, S3), never to a local disk of an
executor. Bundles are read back frame by frame.

Null html is an empty payload; a null page_id is kept as null. Rows with the same page_id and payload are all
responses if their id is the smallest of the group. Repeated rows are records of their own; a page longer than a frame
is a frame of its own; an empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import cut, maybe_broadcast, new_folder, table

MIN_REVISIT = 100
FRAME, BUNDLE = 256 << 10, 64 << 20
CAPTURED = "2024-01-01T00:00:00Z"
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed values of WARC/1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "page_id long, bundle string, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store's client and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {CAPTURED}",
        "WARC-Target-URI: " + quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-2:-2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and the end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 4 + size + 4


def _id(head: dict, name: str) -> int | None:
    value = head.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


class Bundle:
    """One open bundle of a task."""

    def __init__(self, folder: str):
        fs, root = store(folder)
        self.name = f"records-{TaskContext.get().partitionId() if TaskContext.get() else 0:05d}-{uuid.uuid4().hex}.warc.zst"
        fs.create_dir(root, recursive=True)
        self.out, self.frames, self.at = fs.open_output_stream(f"{root}/{self.name}", compression=None), [], 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def frame(self, data: bytes) -> tuple[int, int]:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame, from the end of a bundle."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries, out, at = file.read_at(count * width, size - 9 - count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), *((n, pa.int64()) for n in ("frame_offset", "frame_bytes", "record_offset", "record_bytes"))])
        bundle, buffer, held, filled = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, buffer, held, filled
            bundle = bundle or Bundle(folder)
            at, size = bundle.frame(b"".join(buffer))
            rows = [(p, bundle.name, at, size, o, n) for p, o, n in held]
            if bundle.at >= BUNDLE:
                bundle.close()
                bundle = None
            buffer, held, filled = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            html = batch.column("html").cast(pa.binary())
            for p, u, h, r in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), html, batch.column("refers_to").to_pylist(), strict=True):
                data = record(p, u, h.as_py() or b"", r)
                held.append((p, filled, len(data)))
                buffer.append(data)
                filled += len(data)
                if filled >= FRAME:
                    yield flush()
        if buffer:
            yield flush()
        if bundle:
            bundle.close()

    return run


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as file:
                    for at, packed, plain in seek_table(file):
                        data, rows, pos = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain), [], 0
                        while pos < len(data):
                            head, block, pos = parse(data, pos)
                            kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                            body = block.partition(b"\r\n\r\n")[2]
                            if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                                raise ValueError(f"damaged record in {name}")
                            rows.append((_id(head, "WARC-Record-ID"), size, digest, kind, _id(head, "WARC-Refers-To"), head["WARC-Target-URI"], body if payloads and kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes bundles and the index of pages (page_id, url, html); returns the committed index."""
    pages = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    sized = pages.filter(F.octet_length("html") >= MIN_REVISIT)
    firsts = cut(sized.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = pages.join(maybe_broadcast(firsts, firsts.count()), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id"))
    joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder), INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of an archive; a response is checked against its digest."""
    bundles = cut(spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct())
    # A task per bundle, of a bounded size each.
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(_reader(folder, payloads), RECORD)


def fetch(spark: SparkSession, folder: str, page_id: int) -> list[tuple[dict, bytes]]:
    """The records of one page: one frame is read for each."""
    fs, root = store(folder)
    out = []
    for row in spark.read.schema(INDEX).parquet(f"{folder}/index").filter(F.col("page_id") == page_id).collect():
        with fs.open_input_file(f"{root}/{row.bundle}") as file:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read_at(row.frame_bytes, row.frame_offset))
        out.append(parse(data, row.record_offset)[:2])
    return out


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1),
r AS (SELECT p.*, CASE WHEN page_id IS NULL OR page_id > first_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
