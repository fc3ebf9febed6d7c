"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of whole records, then a skippable frame with the record index, then
the seek table of the Zstandard seekable format as footer. The index maps record ids to (frame, offset in the
decompressed frame, length), so one record costs one ranged read and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, attempt_name, qualified, scratch, slices, small_batches, written

#: Skippable frames for the index and for the seek table, and the end of a seek table.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Raw bytes after which a frame ends.
FRAME = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class BundleWriter:
    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held, self.size = [], 0

    def add(self, record_id: str, record: bytes) -> tuple[int, int]:
        at = len(self.frames), self.size
        self.index.append((record_id, *at, len(record)))
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME:
            self.flush()
        return at

    def flush(self) -> None:
        if self.held:
            frame = self.pack.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.pack.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<2I", INDEX_MAGIC, len(index)) + index)
        entries = [*self.frames, (8 + len(index), 0)]
        table = b"".join(struct.pack("<2I", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<2I", TABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Records of an open bundle, all or by id."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.unpack = zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end")
        table = np.frombuffer(self._read(size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts, self.sizes = np.concatenate(([0], table[:, 0].cumsum())), table
        index = self._read(int(self.starts[n - 1]) + 8, int(table[n - 1, 0]) - 8)
        self.index = [tuple(x) for x in json.loads(self.unpack.decompress(index))]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        return self.unpack.decompress(self._read(int(self.starts[i]), int(self.sizes[i, 0])), max_output_size=int(self.sizes[i, 1]))

    def record(self, record_id: str) -> bytes:
        _, frame, at, n = next(x for x in self.index if x[0] == record_id)
        return self.frame(frame)[at : at + n]

    def records(self):
        """(record id, record) in file order, a frame at a time."""
        now, raw = -1, b""
        for name, frame, at, n in self.index:
            if frame != now:
                now, raw = frame, self.frame(frame)
            yield name, raw[at : at + n]


def record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _line(name: str, value) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value)) if name == "WARC-Target-URI" else value
    return f"{name}: {safe}\r\n".encode()


def make_record(name: str, page_id, url: str | None, payload: bytes, digest: str, first_id=None, first_name: str | None = None) -> bytes:
    """A response record, or, with first_name, a revisit record: the HTTP header stays, the payload is left out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", len(payload)) + b"\r\n"
    body = http if first_name else http + payload
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "revisit" if first_name else "response") + _line("WARC-Record-ID", name) + _line("WARC-Date", DATE)
    head += _line("WARC-Target-URI", url or "about:blank") + _line("WARC-Payload-Digest", f"sha1:{digest}")
    if page_id is not None:
        head += _line("X-Page-ID", page_id)
    if first_name:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", first_name) + _line("X-Refers-To-Page-ID", first_id)
    return head + _line("Content-Type", "application/http;msgtype=response") + _line("Content-Length", len(body)) + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.decode().split(": ", 1) for x in head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:]), payload


def write_warc(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes one record a row to bundles in folder; gives the index (page_id, record_id, file, frame, offset, length).

    Of rows with equal payloads of at least `least` bytes, that with the smallest id is the response, the others
    revisit it; all smaller payloads are responses. A null payload is empty. Of repeated rows with that smallest
    id, one is the response. Rows with a null id are revisits if the payload has a row with an id, else responses.
    Null addresses become about:blank; control characters in them are percent-encoded. Other columns aren't read.
    Bundles are named by task attempt and count once the index names them.
    """
    spark, folder = pages.sparkSession, qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    ids = written(rows.select("page_id", "digest", "bytes"), "payload-digests")
    firsts = written(ids.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "payload-firsts")
    again = ids.join(firsts, "digest").select("page_id", "digest", "first").distinct().withColumnRenamed("page_id", "again_id").withColumnRenamed("digest", "again_digest")
    rows = rows.repartition("page_id", "digest")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    rows = rows.select("page_id", "digest", "url", "html", "first").sortWithinPartitions("page_id", "digest")

    def write(batches):
        files, name, bundle, out, last, copy = Files(folder), attempt_name("bundle") + ".warc.zst", None, None, None, 0
        kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        for columns in slices(batches):
            if bundle is None:
                out = files.create(name)
                bundle = BundleWriter(out)
            found = []
            for page_id, digest, url, html, first in zip(*columns, strict=True):
                copy = copy + 1 if last == (page_id, digest) else 0
                last = page_id, digest
                code = base64.b32encode(bytes.fromhex(digest)).decode()
                own = record_id(page_id, digest, copy)
                revisit = first is not None and (page_id != first or copy > 0)
                record = make_record(own, page_id, url, html.encode(), code, *((first, record_id(first, digest, 0)) if revisit else ()))
                frame, at = bundle.add(own, record)
                found.append((page_id, own, name, frame, at, len(record)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)
        if bundle is not None:
            bundle.close()
            out.close()

    return written(small_batches(rows).mapInArrow(write, "page_id long, record_id string, file string, frame long, offset long, length long"), "warc-index")


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the bundles that the index
    names. Fails if a response's payload doesn't have its digest."""
    spark, folder = index.sparkSession, qualified(index.sparkSession, folder)
    names = [(r.file,) for r in index.select("file").distinct().collect()]  # a row per bundle

    def read(batches):
        files = Files(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open(name) as source:
                    out = []
                    for own, raw in BundleReader(source).records():
                        fields, http, payload = parse_record(raw)
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        n = int(http["Content-Length"])
                        if fields["WARC-Record-ID"] != own or (kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest)):
                            raise ValueError(f"{name}: {own} is damaged")
                        page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        out.append((page and int(page), n, digest, kind, first and int(first)))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return spark.createDataFrame(names, "file string").repartition(max(1, len(names))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  translate(lpad(to_base(('0x' || hex[1:10])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || hex[11:20])::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || hex[21:30])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || hex[31:40])::BIGINT, 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
