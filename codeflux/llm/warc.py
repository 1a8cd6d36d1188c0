"""WARC archives as seekable Zstandard bundles.

A bundle is a run of WARC/1.1 records. Records are grouped into frames that decompress on their own; a skippable frame
at the end holds the seek table (the public seekable format: compressed and plain size of each frame), and the index
maps each record to its frame, the frame's place in the bundle and the record's offset in the plain frame. Bundles are
rows of a table, written by Spark's committer, so a lost or repeated task leaves no half-written or double bundle;
``export`` writes them out as files.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are never revisits; of equal longer
payloads the rows with the smallest page_id are responses (rows that repeat with that very id too) and all others
revisit that id; a null page_id counts as largest; a null url leaves out the target header; an empty table gives no
bundles; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small

LEAST_BYTES = 100
FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 256 << 10, 64, 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = (
    "bundle string, data binary, records array<struct<page_id:bigint,frame:int,frame_start:bigint,frame_bytes:bigint,"
    "offset:bigint,length:bigint>>"
)
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, first: the page to refer to, null for responses."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    groups = slim.where(f"n >= {least}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    shared = materialize(groups.where("rows > 1").select("digest", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if small(shared):
        joined = slim.join(F.broadcast(shared), "digest", "left")
    else:  # ids meet the digests without their pages, so a page that very many share is no hot key
        marks = slim.select("page_id", "digest").join(shared, "digest").where(revisit).distinct().alias("m")
        on = F.col("s.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("s.digest") == F.col("m.digest"))
        joined = slim.alias("s").join(marks, on, "left").select("s.page_id", "url", "html", "s.digest", "first")
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("first"))


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    lines = [f"WARC-Type: {'response' if first is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    body = HTTP + (payload if first is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a plain frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in frame[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        yield head, frame[end + 4 : stop]
        at = stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    start, found = 0, []
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        found.append((start, packed, plain))
        start += packed
    return found


class _Bundle:
    def __init__(self):
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.data, self.sizes, self.records = bytearray(), [], []
        self.plain, self.open = bytearray(), []

    def add(self, page_id, raw: bytes) -> None:
        self.open.append((page_id, len(self.plain), len(raw)))
        self.plain += raw
        if len(self.plain) >= FRAME_BYTES or len(self.open) >= FRAME_RECORDS:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed, start = self.pack(bytes(self.plain)), len(self.data)
            keys = ("page_id", "frame", "frame_start", "frame_bytes", "offset", "length")
            self.records += [dict(zip(keys, (i, len(self.sizes), start, len(packed), at, n))) for i, at, n in self.open]
            self.sizes.append((len(packed), len(self.plain)))
            self.data += packed
            self.plain, self.open = bytearray(), []

    def close(self) -> bytes:
        self.close_frame()
        return bytes(self.data) + seek_table(self.sizes)


def _write(schema: pa.Schema):
    def write(batches):
        part, seq, bundle = TaskContext.get().partitionId(), 0, _Bundle()

        def row():
            data = bundle.close()
            return pa.RecordBatch.from_pylist([{"bundle": f"part-{part:06d}-{seq:05d}.warc.zst", "data": data, "records": bundle.records}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, first = (batch.column(c)[i].as_py() for c in range(5))
                bundle.add(page_id, record(page_id, url, html, digest, first))
                if len(bundle.data) >= BUNDLE_BYTES:
                    yield row()
                    seq, bundle = seq + 1, _Bundle()
        if bundle.records or bundle.open:
            yield row()

    return write


def write_archives(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The table of bundles: bundle, data, records (the index)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(BUNDLES))
    return materialize(plan_records(pages, least).mapInArrow(_write(schema), BUNDLES), "none")


def _decode(head: dict[str, str], block: bytes, payload: bool) -> dict:
    page = re.fullmatch(r"<urn:page:(-?\d*)>", head["WARC-Record-ID"])[1]
    first = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("WARC-Refers-To", "<urn:page:0>"))[1]
    kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
    body = block.split(b"\r\n\r\n", 1)[1]
    if kind == "response":
        n = len(body)
        if hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"page {page}: the payload does not match its digest")
    url = head.get("WARC-Target-URI")
    return {
        "page_id": int(page) if page else None,
        "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(first) if kind == "revisit" else None,
        "payload": body if payload and kind == "response" else None,
    }


def read_archives(bundles: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the bundles, frame by frame; digests of responses are checked against their payloads."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(READ))

    def read(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for cell in batch.column(0):
                bundle = cell.as_py()
                for start, packed, _ in frames(bundle):
                    plain = unpack(bundle[start : start + packed])
                    yield pa.RecordBatch.from_pylist([_decode(h, b, payload) for h, b in parse(plain)], schema)

    return bundles.select("data").mapInArrow(read, READ)


def lookup(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (page_id) alone: the index picks bundle and frame, and only those frames are cut out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(READ))
    found = bundles.select("bundle", F.explode("records").alias("r")).join(ids.select(F.col("page_id").alias("id")).distinct(), F.col("r.page_id") == F.col("id"), "left_semi")
    data = bundles.select("bundle", "data").join(found, "bundle")
    cut = data.select(F.substring("data", F.col("r.frame_start").cast("int") + 1, F.col("r.frame_bytes").cast("int")).alias("frame"), "r.offset", "r.length")

    def read(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = [next(parse(unpack(r["frame"])[r["offset"] : r["offset"] + r["length"]])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([_decode(h, b, True) for h, b in rows], schema)

    return cut.mapInArrow(read, READ)


def export(bundles: DataFrame, folder: str) -> None:
    """Writes each bundle as a file of ``folder``, a path or address that all executors reach (also of an object store); a
    repeated task replaces its files."""
    address = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def save(rows):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(address)
        for r in rows:
            tmp = f"{base}/.{r.bundle}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(tmp) as f:
                f.write(r.data)
            fs.move(tmp, f"{base}/{r.bundle}")

    bundles.select("bundle", "data").foreachPartition(save)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, data of the files that ``export`` wrote, for ``read_archives``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), F.col("content").alias("data"))
