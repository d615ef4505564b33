"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole
records, and a skippable frame with the seek table of the seekable format: the
compressed and the plain size of each frame, their number and the magic number.
An index maps each record to its bundle, its frame and its offset in the plain
frame, so one record costs one seek and one frame.

Pages whose payload occurred under a larger id become revisit records that
refer to that page's response.

Defined cases: a null payload counts as empty.  Of equal payloads of at least
``min_bytes`` bytes the row with the largest id is the response (null is
smaller than any id; of rows repeated with one id it is exactly one); smaller
payloads are all responses.  A null address leaves its header out, and
characters that can't stand in a header are percent-encoded.  A record larger
than a frame is a frame of its own.  An empty table writes no bundle.  Other
columns are ignored.  Bundles of a task that is lost or repeated have names of
their own; nothing refers to them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_per_key, tidy

#: Plain bytes of a frame; plain bytes and records of a bundle.
FRAME, BUNDLE, RECORDS = 256 << 10, 32 << 20, 50_000
#: Fixed values of the seekable format: magic numbers of the skippable frame
#: that holds the table and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


#: Hadoop's names of object stores, and those that Arrow has for the same.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if colon and scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    if re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pyarrow.fs.LocalFileSystem(), uri


def record_id(page: int | None, tag: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{tag}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[2]
    return int(page) if page else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, tag: int, url: str | None, payload: bytes, original: tuple[int | None, int] | None, date: str) -> bytes:
    """A response record, or a revisit record that refers to ``original``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record_id(page, tag)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F))))
    head.append("WARC-Payload-Digest: sha1:" + payload_digest(payload))
    if original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*original)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> dict:
    """A record's page, type, full payload's size and digest, and what it refers
    to; ValueError if it isn't whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    size = int(warc["Content-Length"])
    block = rest[:size]
    if not head.startswith(b"WARC/1.1\r\n") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    full, digest = int(fields(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
    if warc["WARC-Type"] == "response" and (len(payload) != full or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {warc['WARC-Record-ID']} was changed")
    refers = warc.get("WARC-Refers-To")
    return {
        "page_id": page_of(warc["WARC-Record-ID"]),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": warc["WARC-Type"],
        "refers_to": page_of(refers) if refers else None,
    }


class BundleWriter:
    """Writes one bundle; its file has its name only once it is whole."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.fs, self.path = store(f"{folder}/{self.name}")
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".tmp", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer = bytearray()
        self.plain = self.records = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset in the plain frame and length of the record."""
        if self.buffer and len(self.buffer) + len(raw) > FRAME:
            self.flush()
        at = len(self.buffer)
        self.buffer += raw
        self.plain += len(raw)
        self.records += 1
        return len(self.frames), at, len(raw)

    def flush(self) -> None:
        frame = self.compressor.compress(bytes(self.buffer))
        self.out.write(frame)
        self.frames.append((len(frame), len(self.buffer)))
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)


class BundleReader:
    """Random access to a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        fs, path = store(f"{folder}/{name}")
        self.file = fs.open_input_file(path)
        end = self.file.size()
        number, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError(f"{name} has no seek table without checksums")
        sizes = struct.unpack(f"<{2 * number}I", self.file.read_at(8 * number, end - 9 - 8 * number))
        self.sizes, at = list(zip(sizes[::2], sizes[1::2])), 0
        self.starts = []
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), max_output_size=plain)


INDEX = "page_id long, tag long, bundle string, frame int, start long, length long"


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to bundles in ``folder``; return the index, a stored
    table.  Payloads are shuffled once, by digest; those of heavy groups of
    copies not at all."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = scratch.keep(
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            F.monotonically_increasing_id().alias("tag"),
            F.col(url_col).cast("string").alias("url"),
            payload.alias("payload"),
            F.unhex(F.sha2(payload, 256)).alias("digest"),
        ),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("digest").agg(F.max(F.struct("page_id", "tag")).alias("top"), F.count(F.lit(1)).alias("n")), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        for batch in batches:
            places = []
            for x in batch.to_pylist():
                body = x["payload"].encode()
                original = (x["top"]["page_id"], x["top"]["tag"])
                if original[1] == x["tag"] or len(body) < min_bytes:
                    original = None
                if writer and (writer.plain >= BUNDLE or writer.records >= RECORDS):
                    writer.close()
                    writer = None
                writer = writer or BundleWriter(folder)
                places.append((x["page_id"], x["tag"], writer.name, *writer.add(record(x["page_id"], x["tag"], x["url"], body, original, date))))
            if places:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*places), kinds)], ["page_id", "tag", "bundle", "frame", "start", "length"])
        if writer:
            writer.close()

    return scratch.keep(join_per_key(rows, groups, "digest", "n").select("page_id", "tag", "url", "payload", "top").mapInArrow(tidy(run), INDEX), "index")


def read_archives(index: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Read every record of the index back, frame by frame, and check it; in
    ``tasks`` tasks, by default the session's shuffle partitions."""

    def run(table: pa.Table) -> pa.Table:
        reader = BundleReader(folder, table["bundle"][0].as_py())
        number, plain, found = -1, b"", []
        for x in table.sort_by([("frame", "ascending"), ("start", "ascending")]).to_pylist():
            if x["frame"] != number:
                number, plain = x["frame"], reader.frame(x["frame"])
            found.append(parse(plain[x["start"] : x["start"] + x["length"]]))
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        return pa.table({c: pa.array([f[c] for f in found], k) for c, k in kinds.items()})

    # As many tasks as bundles or cores allow: an index is small, what it names isn't.
    index = index.repartition(tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bundle")
    return index.groupBy("bundle").applyInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
