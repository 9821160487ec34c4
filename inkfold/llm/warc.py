"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent frames, each of some whole records, with a seek table in a skippable frame at the
end, so that readers without a seek table can read it too. An index maps each record's identifier to its frame and its
offset in that frame's records. Bundles are rows of a table with the file's bytes: Spark writes and reads them wherever
the cluster keeps its data.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, tune

#: Bytes of records in a frame, and of records in a bundle; a larger record is a frame, or a bundle, of its own.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Of the seekable format: the magic numbers of a skippable frame and of the seek table. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: When the records were made, unless the caller says.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a row's record is: too small to be compared, the response of its payload, a revisit.
SMALL, FIRST, AGAIN = 0, 1, 2
_PAGE = re.compile(rb"<urn:page:(-?\d*):[^<>]*>")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, what: str) -> str:
    """`what` tells a page's records apart: a payload's digest for its one response, and a place in the bundles for others."""
    return f"<urn:page:{'' if page_id is None else page_id}:{what}>"


def record(what: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """A response record, or a revisit of another page's. A revisit keeps the HTTP head, which has the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, what)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, payload_digest(payload))}", f"WARC-Profile: {REVISIT}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.open, self.size, self.index = bytearray(), 0, []

    def add(self, page_id: int | None, what: str, raw: bytes) -> None:
        if self.open and len(self.open) + len(raw) > self.frame_bytes:
            self._close()
        self.index.append({"page_id": page_id, "what": what, "frame": len(self.frames), "offset": len(self.open), "length": len(raw)})
        self.open += raw
        self.size += len(raw)

    def _close(self) -> None:
        self.frames.append(self.pack.compress(bytes(self.open)))
        self.table.append((len(self.frames[-1]), len(self.open)))
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at = len(bundle) - 9 - entry * count
    if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE, entry * count + 9):
        raise ValueError("the seek table's frame is damaged")
    out, start = [], 0
    for i in range(count):
        packed, size = struct.unpack("<II", bundle[at + entry * i : at + entry * i + 8])
        out.append((start, packed, size))
        start += packed
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry; only its frame is decompressed."""
    start, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)[offset : offset + length]


def parse(frame: bytes) -> Iterator[tuple[dict[str, bytes], bytes, bytes]]:
    """(fields in lower case, HTTP head, payload) of each record of a frame."""
    at = 0
    while at < len(frame):
        split = frame.index(b"\r\n\r\n", at)
        lines = frame[at:split].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.decode().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = frame[split + 4 : split + 4 + size]
        if len(block) != size or frame[split + 4 + size : split + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        head, _, payload = block.partition(b"\r\n\r\n")
        yield fields, head, payload
        at = split + 8 + size


def _bundles(frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, writer = TaskContext.get().partitionId(), 0, 0, BundleWriter(frame_bytes)
        index = pa.list_(pa.struct([("page_id", pa.int64()), ("what", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([writer.finish()], pa.binary()), pa.array([writer.index], index)], names=["bundle", "content", "records"])

        for batch in batches:
            for page, url, html, first, role in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "role")), strict=True):
                payload, at = html.encode("utf-8", "surrogatepass"), at + 1
                what = payload_digest(payload) if role == FIRST else f"{part}.{at}"
                raw = record(what, page, url, payload, first, role == AGAIN, date)
                if writer.size and writer.size + len(raw) > bundle_bytes:
                    yield done()
                    number, writer = number + 1, BundleWriter(frame_bytes)
                writer.add(page, what, raw)
        if writer.size:
            yield done()

    return run


BUNDLES = "bundle string, content binary, records array<struct<page_id:bigint,what:string,frame:bigint,offset:bigint,length:bigint>>"


def bundles(pages: DataFrame, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """A row for each bundle: its file name, its bytes, and its records' index.

    pages: page_id, url, html; other columns are ignored. Null html is an empty payload, a null url is `urn:none`. Of equal
    payloads of at least least_bytes, the row with the smallest page_id is written as a response and the others as its
    revisits; a null page_id counts as the largest. Of rows that repeat that page_id and payload, the one with the smallest
    url, and of those one of the table's, is the response. Every record has an identifier of its own. An empty table gives
    no bundle.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.sha2("html", 256))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # Written, so that the join has an exchange on either side and the copies of one payload can be split.
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "row")
    first = materialize(rows.groupBy("same").agg(F.min(order).alias("first")).select("same", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    role = F.when(F.octet_length("html") < least_bytes, SMALL).when(F.col("row") == F.col("first_row"), FIRST).otherwise(AGAIN)
    told = rows.join(first.hint("merge"), "same").select("page_id", "url", "html", "first_id", role.alias("role"))
    return told.mapInArrow(_bundles(frame_bytes, bundle_bytes, date), BUNDLES)


def index(found: DataFrame) -> DataFrame:
    """record_id, page_id, bundle, frame, offset, length: where each record is, offset within its frame's records."""
    rows = found.select("bundle", F.explode("records").alias("r")).select("r.*", "bundle")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), "what", F.lit(">"))
    return rows.select(name.alias("record_id"), "page_id", "bundle", "frame", "offset", "length")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()

    def page(urn: bytes | None) -> int | None:
        found = _PAGE.fullmatch(urn or b"")
        return int(found[1]) if found and found[1] else None

    for batch in batches:
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
            raw = content.as_buffer().to_pybytes()
            out: list[tuple] = []
            for start, packed, size in seek_table(raw):
                for fields, head, payload in parse(unpack.decompress(raw[start : start + packed], max_output_size=size)):
                    kind = fields["warc-type"].decode()
                    digest = fields["warc-payload-digest"].decode().removeprefix("sha1:")
                    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                    if kind == "response" and (length != len(payload) or digest != payload_digest(payload)):
                        raise ValueError(f"{name}: a payload doesn't have its record's digest")
                    out.append((page(fields["warc-record-id"]), fields["warc-target-uri"].decode(), kind, page(fields.get("warc-refers-to")), length, digest, payload if kind == "response" else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def records(found: DataFrame) -> DataFrame:
    """Read bundles: a row for each record, payload null for revisits. Digests and lengths of responses are verified."""
    return found.select("bundle", "content").mapInArrow(_records, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")
