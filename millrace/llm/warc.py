"""WARC archives: a writer of one gzip member per record and a sequential reader.

An archive is a run of gzip members.  The reader inflates it piece by piece with zlib, frames each record by its Content-Length in the
inflated bytes, wherever members begin and end (the writer's have one record each; others' may hold several, or part of one), and verifies block and payload digests;
a truncated or altered archive raises ValueError.  It holds a piece and a record.
Archives are kept as rows of at most about `size` bytes of a table in the shared folder, written under Spark's
commit protocol, so a retried task leaves no half-written archive; `export` writes them out as .warc.gz files, read_files() reads such files.

A null payload is empty; a null url is named by the page's id; a null id is written as null and never refers to
anything nor is referred to.  Rows that repeat an id with an equal payload are all responses.  An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, stored
from .text import buffers

END = b"\r\n\r\n"
PIECE = 1 << 16


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        if "msgtype=response" in self.headers.get("content-type", ""):
            return self.block.partition(END)[2]
        return self.block


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + END) + pack.flush()


def page_member(page_id, url: str | None, payload: bytes, first, level: int = 6) -> bytes:
    """The record of a page; first: the id that a revisit refers to, else None."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if first is not None else payload)
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url, safe="/:?&=#%+,;@!$'()*~[]") if url else f"urn:page:{page_id}"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if first is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return member(headers, block, level)


def inflated(pieces) -> Iterator[bytes]:
    """The bytes of a run of gzip members, given in pieces, as they come out of zlib."""
    unpack, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            begun = True
            try:
                out = unpack.decompress(piece, PIECE)
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from e
            if out:
                yield out
            piece = unpack.unconsumed_tail
            if unpack.eof:
                piece, unpack, begun = unpack.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a member")


def header(raw: bytes) -> tuple[dict[str, str], int]:
    """A record's header lines by lower-case name, and the length of its block."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    return headers, int(headers["content-length"])


def verified(record: Record) -> Record:
    """The record, if its digests hold (SHA-256 ones as the writer writes them; others are not checked)."""
    checks = [("warc-block-digest", record.block)] + [("warc-payload-digest", record.payload)] * (record.headers.get("warc-type") == "response")
    for name, data in checks:
        stated = record.headers.get(name, "")
        if stated.startswith("sha256:") and stated != f"sha256:{hashlib.sha256(data).hexdigest()}":
            raise ValueError(f"{name} does not match")
    return record


def framed(pieces) -> Iterator[Record]:
    """The records of inflated bytes, given in pieces: header lines, an empty line, a block of the stated length, two line breaks."""
    held, headers, need = bytearray(), None, 0
    for piece in pieces:
        held += piece
        while True:
            if headers is None:
                end = held.find(END, max(0, need - len(END)))
                if end < 0:
                    need = len(held)
                    break
                headers, length = header(bytes(held[:end]))
                del held[: end + len(END)]
                need = length + len(END)
            if len(held) < need:
                break
            if held[need - len(END) : need] != END:
                raise ValueError(f"content length {need - len(END)}, but no record ends there")
            yield verified(Record(headers, bytes(held[: need - len(END)])))
            del held[:need]
            headers, need = None, 0
    if headers is not None or held:
        raise ValueError("the archive ends within a record")


def read_archive(data: bytes) -> Iterator[Record]:
    view = memoryview(data)
    return framed(inflated(view[i : i + PIECE] for i in range(0, len(view), PIECE)))


def packed(size: int, level: int):
    def pack(batches):
        held, total = [], 0
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            raw = data.tobytes()
            for i, (page, url, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                held.append(page_member(page, url, raw[offsets[i] : offsets[i + 1]], first, level))
                total += len(held[-1])
                if total >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int32())], names=["archive", "records"])
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int32())], names=["archive", "records"])

    return pack


def write_archives(pages: DataFrame, least: int = 100, size: int = 4 << 20, level: int = 4) -> DataFrame:
    """pages (page_id, url, html) -> the stored table of archives (archive, records).

    Of rows with equal payloads of at least `least` bytes, the smallest page_id is a response and the others revisit it.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = pages.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = pages.join(firsts, "digest", "left").select("page_id", "url", "html", F.expr("if(page_id != first and page_id is not null, first, null)").alias("first"))
    return stored(rows.mapInArrow(packed(size, level), "archive binary, records int"))


def unpacked(batches):
    def number(name):
        text = name.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "null" else int(text)

    for batch in batches:
        for data in batch.column(0):
            rows = []
            for record in read_archive(data.as_buffer()):
                h = record.headers
                rows.append((number(h["warc-record-id"]), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], number(h["warc-refers-to"]) if "warc-refers-to" in h else None, h["warc-target-uri"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of a table of archives; each archive is read from its first byte to its last."""
    return archives.select("archive").mapInArrow(unpacked, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes the archives as .warc.gz files into a folder of this machine, one at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for i, row in enumerate(archives.select("archive").toLocalIterator()):
        names.append(f"{folder}/{i:06d}.warc.gz")
        Path(names[-1]).write_bytes(row["archive"])
    return names


def records(batches):
    names = ["path", "place", "record_type", "record_id", "target_uri", "payload", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for place, r in enumerate(read_archive(data.as_buffer())):
                h = r.headers
                rows.append((path, place, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), r.payload, hashlib.sha256(r.payload).hexdigest()))
                held += len(r.payload)
                if held > 64 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.gz files of any writer: path, place (in the file, from 0), record_type, record_id, target_uri, payload, payload_digest (bare hex SHA-256).

    A file is a row and read by one task, which holds its compressed bytes (Spark reads files of up to 2 GB in this way).
    """
    found = bounded(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select("path", "content").mapInArrow(records, "path string, place long, record_type string, record_id string, target_uri string, payload binary, payload_digest string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, payload_digest,
  CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first = d.page_id THEN NULL ELSE f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
