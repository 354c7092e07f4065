"""WARC archives in seekable Zstandard bundles (operator 7).

A bundle is a file of independent Zstandard frames, each with a group of WARC records, and ends in the public seekable
format's table (a skippable frame with the sizes of all frames). The index maps a record to its bundle, frame and
offset within the frame, so one record costs one seek and one frame.

Which page of equal payloads is stored is decided on keys alone, and pages are dealt out by their id, so neither a
popular payload nor a large source meets in one task. A bundle's name is new for every attempt of a task; only bundles
of attempts that succeeded reach the index.

Cases: a null or empty page is a response without payload; a null url is written as an empty one and line ends in it
are escaped; a null id is never a group's response if the group has another id; rows that repeat id and payload are
records of their own and of one kind; an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import filesystem, new_folder, pieces, unique_name
from postsieve.plans.durable import written

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Payloads below this are always stored.
LEAST_REVISIT = 100
#: A frame is closed at so many bytes, a bundle at so many frames.
FRAME_BYTES = 256 << 10
BUNDLE_FRAMES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record with its HTTP head; a revisit leaves the payload out."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str, int | None, int, str, bytes]:
    """Page id, kind, page referred to, payload size, digest and payload of a record. A stored payload that does not
    fit its digest fails."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1" or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[:-4]
    if len(block) != int(field["Content-Length"]):
        raise ValueError("block length differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    refers = field.get("WARC-Refers-To")
    return _page(field["WARC-Record-ID"]), kind, _page(refers) if refers else None, size, digest, payload


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn[len("<urn:x-page:"):-1]
    return int(number) if number else None


class Bundle:
    """A bundle being written."""

    def __init__(self, name: str):
        system, path = filesystem(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.name, self._out, self._packer = name, system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3)
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self._held = 0

    @property
    def full(self) -> bool:
        return len(self._sizes) >= BUNDLE_FRAMES

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record within it."""
        place = len(self._sizes), self._held
        self._open.append(data)
        self._held += len(data)
        if self._held >= FRAME_BYTES:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        packed = self._packer.compress(b"".join(self._open))
        self._out.write(packed)
        self._sizes.append((len(packed), self._held))
        self._open, self._held = [], 0

    def close(self) -> None:
        if self._open:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self._sizes)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC))
        self._out.close()


class Reader:
    """Frames of a bundle by number, through its footer."""

    def __init__(self, name: str):
        system, path = filesystem(name)
        self._file = system.open_input_file(path)
        size = self._file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        entry = 12 if descriptor & 0x80 else 8  # with a checksum of each frame
        table = self._file.read_at(frames * entry, size - 9 - frames * entry)
        self._sizes = [struct.unpack_from("<II", table, i * entry) for i in range(frames)]
        self._starts = [0]
        for packed, _ in self._sizes:
            self._starts.append(self._starts[-1] + packed)
        self._number, self._frame = -1, b""

    def read(self, frame: int, at: int, length: int) -> bytes:
        if frame != self._number:
            packed, size = self._sizes[frame]
            data = zstandard.ZstdDecompressor().decompress(self._file.read_at(packed, self._starts[frame]), max_output_size=size)
            self._number, self._frame = frame, data
        return self._frame[at:at + length]

    def close(self) -> None:
        self._file.close()


def _write(batches: Iterable[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    bundle = None
    for piece in pieces(batches, "payload"):
        rows = []
        for page_id, url, payload, digest, refers_to, revisit in zip(*(piece.column(c).to_pylist() for c in (
                "page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
            if bundle is None or bundle.full:
                if bundle is not None:
                    bundle.close()
                bundle = Bundle(f"{folder}/{unique_name('pages', TaskContext.get().partitionId())}.warc.zst")
            data = record(page_id, url, payload, digest, refers_to, revisit, date)
            rows.append((page_id, bundle.name, *bundle.add(data), len(data)))
        yield _batch(rows, INDEX)
    if bundle is not None:
        bundle.close()


def _read(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    name, reader = None, None
    for batch in batches:
        done, held = [], 0
        for bundle, frame, at, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "length")), strict=True):
            if bundle != name:
                if reader is not None:
                    reader.close()
                name, reader = bundle, Reader(bundle)
            *found, payload = parse(reader.read(frame, at, length))
            done.append((*found, payload if payloads else None))
            held += len(payload) if payloads else 100
            if held > 8_000_000:
                yield _batch(done, READ)
                done, held = [], 0
        if done:
            yield _batch(done, READ)
    if reader is not None:
        reader.close()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_bundles(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the bundles below ``folder``; return the index (page_id, bundle, frame, at, length)."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    shared = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("held")).where("held > 1")
    revisits = keys.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("page_id").alias("id"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")), "left").select(
        "page_id", "url", "payload", "digest", "refers_to", F.col("same").isNotNull().alias("revisit"))
    return written(marked.mapInArrow(
        lambda batches: _write(batches, folder, date), "page_id bigint, bundle string, frame int, at bigint, length bigint"))


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that (part of) an index names, parsed and verified. Revisits carry size and digest of the payload
    that their response holds."""
    placed = index.select("bundle", "frame", "at", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "at")
    return placed.mapInArrow(
        lambda batches: _read(batches, payloads),
        "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in a new shared folder and list what the archives hold."""
    return read_bundles(write_bundles(pages, new_folder(pages.sparkSession, "warc"))).drop("payload")


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""
