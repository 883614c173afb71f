"""WARC archives: one gzip member per record, written and read as streams.

Each task writes its rows to files in a folder that every executor can reach, under a name
that is the same when the task runs again, and moves a file into place when it is whole.
The reader takes a file in chunks: it inflates member by member, frames the record by its
Content-Length, and checks the digest of the payload.

Records with equal payloads of at least ``min_bytes`` are written once: that of the smallest
page id is the response, the others revisit it and carry no payload. Null ids come last.
Rows that share id and payload count as one response and revisits of it. A null payload is
empty; a null url leaves the header out. A url stands verbatim in its header, percent signs
included; line ends, control and non-ASCII characters are escaped there, and such a url
stands in X-Target-URI once more with percent signs escaped too. An empty table makes no file and gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from mcqflow.llm.common import checkpointed, new_folder, text_of

FILE_BYTES = 256 << 20
CHUNK = 1 << 18
BROADCAST_DECISIONS = 100_000  # of some 90 bytes
LEVEL = 3
PLAIN = "/:=&?~#+!$,;'@()*[]|^`{}<>\"\\ .-_"  # stand in a header as they are, as do letters and digits
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to bigint, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"")


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()
    return packer.compress(raw + block + b"\r\n\r\n") + packer.flush()


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, one after the other; holds one record at a time."""
    pending = stream.read(chunk)
    while pending:
        inflate, raw = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            if not pending:
                pending = stream.read(chunk)
                if not pending:
                    raise ValueError("the archive ends inside a record")
            raw += inflate.decompress(pending)
            pending = inflate.unused_data
        pending = pending or stream.read(chunk)
        yield _parse(bytes(raw))


def _parse(raw: bytes) -> Record:
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    start, length = end + 4, int(headers["Content-Length"])
    block = raw[start : start + length]
    if len(block) != length or raw[start + length :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    record = Record(headers, block)
    if headers["WARC-Type"] == "response":
        record.payload = block[block.index(b"\r\n\r\n") + 4 :]
        if "sha1:" + payload_digest(record.payload) != headers["WARC-Payload-Digest"]:
            raise ValueError("a payload doesn't have its digest")
    return record


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = pafs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    files: list[str] = []
    out, name, size, serial = None, "", 0, 0

    def close() -> None:
        nonlocal out
        if out is not None:
            out.close()
            store.move(f"{name}.{task.taskAttemptId()}", name)
            files.append(name)
            out = None

    for b in batches:
        columns = [b.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
        for row in zip(*columns, strict=True):
            page, url, html, refers_to, revisit = (x.as_py() for x in row)
            if out is None or size > FILE_BYTES:
                close()
                name, size = f"{root}/part-{task.partitionId():06d}-{len(files):04d}.warc.gz", 0
                out = store.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None)
            payload = html.encode("utf-8")
            serial += 1
            headers = {
                "WARC-Type": "revisit" if revisit else "response",
                "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{task.partitionId()}/{serial}')}>",
                "WARC-Date": DATE,
                "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
                "X-Payload-Bytes": str(len(payload)),
            }
            if url is not None:
                headers["WARC-Target-URI"] = quote(url, safe="%" + PLAIN)
                if headers["WARC-Target-URI"] != url:  # a second header gives back what the first can't hold
                    headers["X-Target-URI"] = quote(url, safe=PLAIN)
            if page is not None:
                headers["X-Page-Id"] = str(page)
            if revisit:
                headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                if refers_to is not None:
                    headers["X-Refers-To"] = str(refers_to)
                block = b""
            else:
                headers["Content-Type"] = "application/http; msgtype=response"
                block = _HTTP % len(payload) + payload
            member = encode_record(headers, block)
            size += len(member)
            out.write(member)
    close()
    yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    from urllib.parse import unquote

    store, _ = pafs.FileSystem.from_uri(folder)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = "page_id url payload_bytes payload_digest record_type refers_to payload".split()[: len(kinds)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for name in b.column("file").to_pylist():
            rows, held = [], 0
            with store.open_input_stream(name, compression=None) as stream:
                for r in read_records(stream):
                    h = r.headers
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    url = unquote(h["X-Target-URI"]) if "X-Target-URI" in h else h.get("WARC-Target-URI")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    row = (number("X-Page-Id"), url, number("X-Payload-Bytes"), digest, h["WARC-Type"], number("X-Refers-To"))
                    rows.append((*row, r.payload) if payloads else row)
                    held += len(r.payload)
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; a row with the path of each file."""
    key = F.concat_ws(".", F.col("page_id").cast("string"), "digest").alias("key")
    rows = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("digest", F.sha1("html"))
    ids = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest", key)
    counted = ids.groupBy("key", "page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("all"))
    # Only what isn't alone needs a decision. Few decisions are sent to all tasks; with many,
    # pages and decisions are exchanged by key.
    again = checkpointed(
        counted.join(first.where("all > 1").drop("all"), "digest").select(
            "key", "n", "first", F.col("page_id").eqNullSafe(F.col("first")).alias("is_first")
        )
    )
    decisions, repeated = again.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    joined = rows.select("page_id", "url", "html", key).join(
        F.broadcast(again) if decisions <= BROADCAST_DECISIONS else again, "key", "left"
    )
    if repeated > 1:  # rows that share id and payload are told apart
        joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("url")))
    else:
        joined = joined.withColumn("nth", F.lit(1))
    decided = joined.select(
        "page_id", "url", "html", F.col("first").alias("refers_to"),
        (F.col("n").isNotNull() & ~(F.col("is_first") & (F.col("nth") == 1))).alias("revisit"),
    )
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return checkpointed(decided.mapInArrow(functools.partial(_write, folder=folder), "file string"))


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record; a revisit has an empty payload. Files are read side by side."""
    work = functools.partial(_read, folder=folder, payloads=payloads)
    schema = SCHEMA if payloads else SCHEMA.removesuffix(", payload binary")
    return files.mapInArrow(work, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read the archives back."""
    folder = new_folder(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
