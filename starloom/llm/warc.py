"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames followed by a seek table in the
seekable format: a skippable frame that lists the compressed and the full size of
every frame. Records are grouped into frames of bounded size; an index maps each
record to (frame, offset inside the frame, length), so one record is read by
decompressing one frame. Bundles are cut at a bounded size and kept as binary
rows of a table that Spark writes, so they live wherever the session's shared
folder lives, and a lost task leaves nothing behind; a bundle's bytes are a
complete .warc.zst file.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a ``response``, the others are ``revisit`` records that carry the
digest and point at it. Rows that repeat that smallest id stay responses. A null
id sorts last, has the record id ``urn:page:null`` and refers like others. Null
payloads are empty. A payload larger than a frame has a frame of its own.
"""

from __future__ import annotations

import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
EPOCH = "1970-01-01T00:00:00Z"
BUNDLE_SCHEMA = "bundle string, data binary, index array<struct<page_id:long,frame:int,offset:long,length:long>>"


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block."""
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {EPOCH}",
            "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class BundleWriter:
    """Frames, seek table and index of one bundle."""

    def __init__(self) -> None:
        self.done, self.sizes, self.index, self.frame, self.total = [], [], [], io.BytesIO(), 0

    def add(self, page_id, raw: bytes) -> None:
        if self.frame.tell() and self.frame.tell() + len(raw) > FRAME_BYTES:
            self._close_frame()
        self.index.append({"page_id": page_id, "frame": len(self.sizes), "offset": self.frame.tell(), "length": len(raw)})
        self.frame.write(raw)

    def _close_frame(self) -> None:
        data = self.frame.getvalue()
        packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(data)
        self.done.append(packed)
        self.sizes.append((len(packed), len(data)))
        self.total += len(packed)
        self.frame = io.BytesIO()

    def size(self) -> int:
        return self.total + self.frame.tell()

    def close(self) -> bytes:
        if self.frame.tell():
            self._close_frame()
        entries = b"".join(struct.pack("<II", c, d) for c, d in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.done, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, full size) of every frame, read from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    table = bundle[-9 - n * width:-9]
    out, start = [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", table, k * width)
        out.append((start, c, d))
        start += c
    return out


def read_frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, full = place
    return zstandard.ZstdDecompressor().decompress(bundle[start:start + packed], max_output_size=full)


def read_at(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry."""
    return parse_record(read_frame(bundle, seek_table(bundle)[frame])[offset:offset + length])


def _bundles(batches):
    from pyspark import TaskContext

    task, writer, k = TaskContext.get().partitionId(), BundleWriter(), 0
    fields = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def row():
        return pa.RecordBatch.from_pydict({"bundle": [f"{task:06d}-{k:06d}.warc.zst"], "data": pa.array([writer.close()], pa.binary()), "index": pa.array([writer.index], pa.list_(fields))})

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to", "revisit")]
        for i in range(batch.num_rows):
            page_id, *rest = (c[i].as_py() for c in columns)
            writer.add(page_id, record(page_id, *rest))
            if writer.size() >= BUNDLE_BYTES:
                yield row()
                writer, k = BundleWriter(), k + 1
    if writer.index:
        yield row()


def records_of(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to, revisit: which rows are written in full."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    # The smallest id of each payload that occurs more than once: summed up in the map tasks, so
    # a payload of many rows moves as one row a task. The pages join it on the stream side.
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("lowest"), F.count("*").alias("n")).where("n > 1").select("digest", "lowest")
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("lowest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lowest"))
    return joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("lowest")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, least: int = 100) -> DataFrame:
    """The written table of bundles: bundle name, bytes, index."""
    return written(records_of(pages, least).mapInArrow(_bundles, BUNDLE_SCHEMA), "warc-bundles")


def _read_back(batches):
    for batch in batches:
        for data, index in zip(batch.column("data"), batch.column("index"), strict=True):
            bundle, entries = data.as_py(), index.as_py()
            table, opened, held = seek_table(bundle), -1, b""
            out = []
            for e in entries:
                if e["frame"] != opened:
                    opened, held = e["frame"], read_frame(bundle, table[e["frame"]])
                fields, block = parse_record(held[e["offset"]:e["offset"] + e["length"]])
                refers = fields.get("WARC-Refers-To")
                out.append({
                    "page_id": None if fields["WARC-Record-ID"] == "<urn:page:null>" else int(fields["WARC-Record-ID"][10:-1]),
                    "url": fields["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
                    "block": block, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                    "record_type": fields["WARC-Type"], "refers_to": int(refers[10:-1]) if refers else None})
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: page_id, url, block, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is taken from the block that was read, not from its header.
    """
    rows = bundles.select("data", "index").mapInArrow(_read_back, "page_id long, url string, block binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    full = F.col("record_type") == "response"
    return rows.withColumn("payload_digest", F.when(full, F.sha2("block", 256)).otherwise(F.col("payload_digest"))).withColumn(
        "payload_bytes", F.when(full, F.length("block").cast("long")).otherwise(F.col("payload_bytes")))
