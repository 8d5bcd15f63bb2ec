"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent frames of whole records, then a skippable frame with the seek table: the
compressed and plain size of every frame (the public seekable format). Beside it lies an index of its records:
identifier, frame, offset in the plain frame, length. One record is read by seeking to its frame alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stash, tasks, text_of
from .storage import reading, writing

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
#: Fixed, so that a rerun writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: The HTTP head before a response's payload; the digest and the full length are those of the payload alone.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INFO = b"software: stagewise\r\nformat: WARC File Format 1.1\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, full: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit names the full payload's digest and length, and carries none of it."""
    body = HTTP + payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + json.dumps(url or "")[1:-1],
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {full}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def about(name: str) -> bytes:
    """The warcinfo record of a bundle."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:bundle:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(INFO)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + INFO + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at an offset (of a response its payload), and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    skipped = len(HTTP) if head["WARC-Type"] == "response" else 0
    return head, data[end + 4 + skipped : end + 4 + size], end + 4 + size + 4


class Bundle:
    """A bundle while it is written: a frame with its warcinfo record, then records, which gather in a frame until it holds frame_bytes."""

    def __init__(self, out: pa.NativeFile, name: str, frame_bytes: int) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.held = bytearray()
        self.size = 0
        self.index: list[tuple[int | None, int, int, int]] = []
        self.held += about(name)
        self.flush()

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, len(self.frames), len(self.held), len(data)))
        self.held += data
        if len(self.held) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(bytes(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), len(self.held)))
            self.size += len(frame)
            self.held.clear()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """Where each frame begins, and its compressed size, from the bundle's last bytes."""
    file.seek(file.size() - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    file.seek(file.size() - 9 - 8 * n)
    raw, at, out = file.read(8 * n), 0, []
    for i in range(n):
        size, _ = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, size))
        at += size
    return out


def lookup(folder: str, name: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by decompressing its frame alone."""
    with reading(f"{folder}/{name}") as file:
        at, size = seek_table(file)[frame]
        file.seek(at)
        head, body, _ = parse(zstandard.ZstdDecompressor().decompress(file.read(size)), offset)
    return head, body


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, payload) with digest, size, record_type and refers_to.

    Of equal payloads of least_bytes or more, the row with the largest page_id is the response and the others
    revisit it; rows that share that id are all responses. Null ids come before all others: among rows without
    an id alone all are responses. Smaller payloads are all responses.
    """
    sha1 = F.unhex(F.sha1("payload"))
    df = pages.withColumns({"sha": sha1, "size": F.octet_length("payload").cast("long")})
    winners = df.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("equal"))
    repeated = winners.where("equal > 1").select(F.col("sha").alias("sha_w"), "winner")
    df = df.join(repeated, (F.col("sha") == F.col("sha_w")) & (F.col("size") >= least_bytes), "left")
    again = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return df.select("page_id", "url", "payload", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("winner")).alias("refers_to"))


INDEX = "name string, page_id long, frame int, offset long, length long"


def write(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for every row of (page_id, url, html) into bundles; returns the index of records.

    Null html is an empty payload, a null url an empty one. No rows write no bundles. A task writes bundle after
    bundle and holds one frame; names come from Spark's partition, so that a task run again replaces its own files.
    """
    from pyspark import TaskContext

    df = roles(pages.select("page_id", "url", F.encode(text_of("html"), "UTF-8").alias("payload")), least_bytes)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for lo in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True))
        row, k = next(rows, None), 0
        while row:
            name = f"{part:06d}-{k:06d}.warc.zst"
            with writing(f"{folder}/{name}") as out:
                bundle = Bundle(out, name, frame_bytes)
                while row and bundle.size < bundle_bytes:
                    page_id, url, payload, size, kind, refers_to = row
                    bundle.add(page_id, record(kind, page_id, url, payload, digest(payload), size, refers_to))
                    row = next(rows, None)
                bundle.close()
            k += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bundle.index)), *(pa.array([x[i] for x in bundle.index], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64())))],
                ["name", "page_id", "frame", "offset", "length"],
            )

    return stash(df.mapInArrow(bundles, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles in the index, from its headers; a response's body must have its digest and length."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            for name, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with reading(f"{folder}/{name}") as file:
                    start, size = seek_table(file)[frame]
                    file.seek(start)
                    data = zstd.decompress(file.read(size))
                    at, rows = 0, []
                    while at < len(data):
                        head, body, at = parse(data, at)
                        kind, sha1 = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        full = int(head["X-Payload-Length"])
                        if kind == "response" and (digest(body) != sha1 or len(body) != full):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        ids = [x.removeprefix("<urn:page:").removesuffix(">") for x in (head["WARC-Record-ID"], head.get("WARC-Refers-To", ""))]
                        rows.append((int(ids[0]) if ids[0] else None, full, sha1, kind, int(ids[1]) if ids[1] else None))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = tasks(index.sparkSession)
    listed = index.groupBy("name", "frame").agg(F.count(F.lit(1)).alias("records"))
    dealt = listed.repartitionById(n, F.pmod(F.xxhash64("name", "frame", "records"), F.lit(n)).cast("int"))  # frames are few and large: no merging of partitions
    return dealt.mapInArrow(opened, READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes), folder)
