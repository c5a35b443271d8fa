"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records of about FRAME bytes together, and ends in
a skippable frame with the seek table (sizes of each frame before and after decompression). The index maps a record to
its bundle, frame number and place within the frame, so a reader seeks to one frame and decompresses only that.

A task names its bundles at random and reports them in its index rows, so what a lost or repeated task leaves behind
is never read. Bundles and index lie in the shared folder.

Of records with equal payloads of MIN_REVISIT bytes or more (equal length and SHA-1) those with the largest id are
responses and the others revisits of it, without a payload of their own. Rows that repeat the largest id are all
responses; a null id revisits any other. Null payloads are empty, null addresses are left out. Empty tables give an
empty index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import new_path, session, written

FRAME, BUNDLE, LEVEL, MIN_REVISIT = 1 << 18, 1 << 27, 3, 1000
#: Fixed values of the seekable format: skippable frame's magic number, footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


def record(record_id, url, payload: bytes, digest: str, length: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. Characters below U+0021 of an address are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>", f"X-Payload-Length: {length}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if len(body) < n + 4:
        raise ValueError("a WARC record is cut short")
    return headers, body[:n]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """Each frame's place, compressed and full size, from the end of a file of that size."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, full in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, full))
        at += packed
    return out


class Bundles:
    """Writes records into bundles below a path; index rows come out once their bundle is complete."""

    def __init__(self, base: str):
        import zstandard
        from pyarrow import fs

        self.fs, self.dir = fs.FileSystem.from_uri(base)
        self.base, self.zstd, self.f = base, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True), None
        self.fs.create_dir(self.dir, recursive=True)

    def _open(self):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.f, self.at, self.frames, self.rows = self.fs.open_output_stream(f"{self.dir}/{self.name}", compression=None), 0, [], []
        self.buffer, self.held, self.fill = [], [], 0

    def add(self, record_id, data: bytes) -> list[tuple]:
        if self.f is None:
            self._open()
        if self.fill and self.fill + len(data) > FRAME:
            self._frame()
        self.held.append((record_id, self.fill, len(data)))
        self.buffer.append(data)
        self.fill += len(data)
        if self.at >= BUNDLE:
            return self.close()
        return []

    def _frame(self):
        packed = self.zstd.compress(b"".join(self.buffer))
        self.f.write(packed)
        self.rows += [(i, f"{self.base}/{self.name}", len(self.frames), self.at, len(packed), at, n) for i, at, n in self.held]
        self.frames.append((len(packed), self.fill))
        self.at += len(packed)
        self.buffer, self.held, self.fill = [], [], 0

    def close(self) -> list[tuple]:
        if self.f is None:
            return []
        if self.fill:
            self._frame()
        self.f.write(seek_table(self.frames))
        self.f.close()
        self.f = None
        return self.rows


def _batches(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def resolve(pages: DataFrame, record_id: str, url: str, payload: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages as records: record_id, url, payload (binary), digest, length, kind, refers_to."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    twice = base.where(F.col("length") >= min_revisit).groupBy("digest", "length").agg(F.max("record_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").drop("n")
    revisit = F.col("keep").isNotNull() & ~F.coalesce(F.col("record_id") == F.col("keep"), F.lit(False))
    return base.join(twice, ["digest", "length"], "left").withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("keep"))).drop("keep")


def write(records: DataFrame) -> DataFrame:
    """Writes the records of `resolve` and gives the index, itself a table in the shared folder."""
    spark = session(records.sparkSession)
    base = new_path(spark, "warc")
    names = ["record_id", "bundle", "frame", "frame_at", "frame_bytes", "at", "bytes"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        out = Bundles(base)
        for batch in batches:
            for i, url, payload, digest, length, kind, to in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record_id", "url", "payload", "digest", "length", "kind", "refers_to")], strict=True):
                if rows := out.add(i, record(i, url, payload, digest, length, kind, to)):
                    yield _batches(rows, names, types)
        if rows := out.close():
            yield _batches(rows, names, types)

    return written(records.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records that the index names: record_id, url, record_type, payload_bytes, payload_digest (hex; of revisits as their headers say), refers_to, payload (null for revisits). Digests are checked against the payloads."""
    spark = session(index.sparkSession)
    names = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        import zstandard
        from pyarrow import fs

        zstd, f, now, rows, held, table, at_frame, data = zstandard.ZstdDecompressor(), None, None, [], 0, [], None, b""
        for batch in batches:
            for bundle, frame, at, n in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bundle", "frame", "at", "bytes")], strict=True):
                if bundle != now:
                    system, path = fs.FileSystem.from_uri(bundle)
                    f, now, at_frame = system.open_input_file(path), bundle, None
                    table = read_seek_table(f, f.size())
                if frame != at_frame:
                    begin, packed, full = table[frame]
                    f.seek(begin)
                    data, at_frame = zstd.decompress(f.read(packed), max_output_size=full), frame
                head, payload = parse(data[at : at + n])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a payload doesn't match its digest")
                number = lambda x: int(x) if (x := x.removeprefix("<urn:record:").rstrip(">")) else None
                rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], int(head["x-payload-length"]) if revisit else len(payload), digest, number(head["warc-refers-to"]) if revisit else None, None if revisit else payload))
                held += len(payload)
                if held > 1 << 24 or len(rows) > 5000:
                    yield _batches(rows, names, types)
                    rows, held = [], 0
        if rows:
            yield _batches(rows, names, types)

    order = index.select("bundle", "frame", "at", "bytes").repartition("bundle", F.expr("frame div 16")).sortWithinPartitions("bundle", "frame", "at")
    return order.mapInArrow(run, "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
