"""WARC archives: distributed writing and sequential reading.

Each writing task fills archives of its own, one gzip member per record, and
returns a row per archive.  Those rows are stored as a table, so only archives of
tasks that succeeded are listed; a repeated task writes under another name.

The reader streams an archive through ``zlib`` block by block.  A record is
framed by its Content-Length, and its block and payload digests are computed while the bytes
pass; a payload is never held unless asked for.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import stored
from scrubline.session import scratch_path

READ_BYTES = 1 << 16
ARCHIVE_BYTES = 256 << 20
MOST_HEADER_BYTES = 1 << 20
# archives are read by a task each, or by so many tasks if there are more
MOST_READERS = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = (
    "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


class BrokenRecord(ValueError):
    """An archive is cut short, badly framed, or does not match its digests."""


# --- one record -------------------------------------------------------------


def _header_value(text: str) -> str:
    """Control characters and blanks would end a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda found: f"%{ord(found[0]):02X}", text)


def record_member(
    page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One record as a gzip member.  A revisit holds no payload, only its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}-{uri}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-Payload-Length: {len(payload)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"Page-Refers-To: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class _Member:
    """The decompressed bytes of one gzip member, as they come."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.ready = stream, rest, bytearray()
        self.unpacker = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.unpacker.eof:
            return False
        source = self.unpacker.unconsumed_tail or self.raw or self.stream.read(READ_BYTES)
        if not source:
            raise BrokenRecord("the archive ends within a record")
        self.raw = b""
        self.ready += self.unpacker.decompress(source, READ_BYTES)
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if seen > most or not self.more():
                raise BrokenRecord("a header has no end")
        found = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return found

    def take(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.ready and not self.more():
                raise BrokenRecord("a block is shorter than its Content-Length")
            piece = bytes(self.ready[:length])
            del self.ready[:length]
            length -= len(piece)
            if piece:
                yield piece

    def rest(self) -> bytes:
        """Read to the end of the member; return the raw bytes that follow it."""
        while self.more():
            if len(self.ready) > 4:
                break
        if bytes(self.ready) != b"\r\n\r\n":
            raise BrokenRecord("a record does not end after its block")
        return self.unpacker.unused_data


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """All records of an archive in order, each checked against its digests."""
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        member = _Member(stream, rest)
        lines = member.until(b"\r\n\r\n", MOST_HEADER_BYTES).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BrokenRecord("no WARC version line")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        left = int(headers["content-length"])
        block, payload, length, head, kept = hashlib.sha256(), hashlib.sha256(), 0, bytearray(), []
        in_payload = not headers.get("content-type", "").startswith("application/http")
        for piece in member.take(left):
            block.update(piece)
            if not in_payload:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    if len(head) > MOST_HEADER_BYTES:
                        raise BrokenRecord("the HTTP header has no end")
                    continue
                in_payload, piece = True, bytes(head[at + 4 :])
            payload.update(piece)
            length += len(piece)
            if keep_payload:
                kept.append(piece)
        if headers.get("warc-block-digest", f"sha256:{block.hexdigest()}") != f"sha256:{block.hexdigest()}":
            raise BrokenRecord("the block does not match its digest")
        claimed = headers.get("warc-payload-digest", f"sha256:{payload.hexdigest()}").removeprefix("sha256:")
        if headers["warc-type"] == "revisit":
            length = int(headers["page-payload-length"])
        elif claimed != payload.hexdigest():
            raise BrokenRecord("the payload does not match its digest")
        yield Record(headers, length, claimed, b"".join(kept) if keep_payload else None)
        rest = member.rest()


# --- tables -----------------------------------------------------------------


def _open(path: str, write: bool):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_stream(inside, compression=None)
    store.create_dir(inside.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inside, compression=None)


def mark_revisits(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", least_bytes: int = 100
) -> DataFrame:
    """Payload, digest, record type and referred page of each row.

    Of equal payloads of at least ``least_bytes``, rows with the smallest id are responses and the
    others revisit them.  A null body is an empty payload.  Rows that repeat the smallest id
    are all responses; a row without an id revisits if its payload has a row with one,
    else it is a response.  Only payloads that occur twice take part in the join.
    """
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(first, "digest", "left")
        .withColumn("revisit", revisit)
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives; return the stored list of archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in columns)):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, write=True)
                member = record_member(*row)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield listed()
        if out is not None:
            out.close()
            yield listed()

    columns = ["page_id", "uri", "payload", "digest", "refers_to", "revisit"]
    return stored(marked.select(*columns).mapInArrow(write, MANIFEST_SCHEMA), "warc-list")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the listed archives, each archive read by one task from start to end.

    The list is short, so adaptive execution would merge all of it into one task; a stated number of tasks stays.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _open(path, write=False) as stream:
                    for record in read_records(stream):
                        get = record.headers.get
                        rows.append(
                            (number(get("page-id")), get("warc-target-uri"), record.payload_bytes,
                             record.payload_digest, get("warc-type"), number(get("page-refers-to")))
                        )
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    tasks = min(max(1, manifest.count()), MOST_READERS)
    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages as archives in the shared folder and read them back, a row per page."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, **columns), folder))
