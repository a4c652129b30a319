"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some records, and a seek table: a skippable frame with the
sizes of all frames and a footer, after the published seekable format, so that common zstd tools read the file as a whole.
The index maps a record's id to (bundle, frame, offset within the frame's content, length). Bundles are written by tasks
under names that no other attempt uses and count only once the index that names them is written, so a lost executor or a
repeated task leaves at worst files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 256 << 20, 3
REVISIT_LEAST = 100
DATE = "2020-01-01T00:00:00Z"
SKIPPABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "record_id string, bundle string, frame int, offset long, length long"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store and path of a shared folder's URI, as tasks open it; a bare path is a mounted folder."""
    if not urlsplit(uri).scheme:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only, and names the record whose payload is the same."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = HTTP if refers_to is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(content: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload (after the HTTP head) of the record at ``at``, and where the next one begins."""
    head_end = content.index(b"\r\n\r\n", at)
    lines = content[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    if content[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where it says")
    block = content[start:end]
    return headers, block[block.index(b"\r\n\r\n") + 4 :], end + 4


class BundleWriter:
    """Appends records to frames, and the seek table at the end. Content goes through ``sink`` as frames fill."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.size, len(data))
        self.pending.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def finish(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *frame) for frame in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, packed size, content size) of each frame, read from a bundle's end."""
    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != FOOTER_MAGIC or flags:
        raise ValueError("not a seekable bundle")
    source.seek(size - 9 - 8 * count)
    entries = struct.unpack(f"<{2 * count}I", source.read(8 * count))
    frames, start = [], 0
    for k in range(count):
        frames.append((start, entries[2 * k], entries[2 * k + 1]))
        start += entries[2 * k]
    return frames


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def with_record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = REVISIT_LEAST) -> DataFrame:
    """(id, url, payload binary, digest, refers_to) of each page: refers_to is the least id among the rows of an equal
    payload of at least ``least`` bytes, null for rows with that id. Shorter payloads refer to none, so however many are equal,
    they are dealt by their rows."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alone = F.concat_ws("-", "id", F.xxhash64("url").cast("string"))
    keyed = rows.withColumn("__key", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(alone))
    found = keyed.join(first.withColumnRenamed("digest", "__key"), "__key", "left")
    return found.select("id", "url", "payload", "digest", F.when(F.col("id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes rows of ``with_record_types`` as bundles under ``folder`` and returns the index, read from ``folder``/index.
    A task closes a bundle at ``bundle_bytes`` and begins another; it holds one frame (or one longer record) at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(f"{root}/bundles", recursive=True)
        writer = sink = None
        name = ""
        rows: list[tuple] = []

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*made, strict=True), kinds, strict=True)], ["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                if writer is None:
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                key = "" if page is None else str(page)
                rows.append((key, name, *writer.add(record(key, url, payload, digest, None if refers_to is None else str(refers_to)))))
                if writer.written >= bundle_bytes:
                    writer.finish()
                    sink.close()
                    writer = None
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if writer is not None:
            writer.finish()
            sink.close()
        if rows:
            yield batch_of(rows)

    spark = records.sparkSession
    records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that ``index`` names: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    A response's digest and length are those of the payload as read, and must be those of its headers; a revisit's are
    its headers'. Bundles are dealt to tasks; a task holds one frame at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{bundle}") as source:
                    for frame in seek_table(source):
                        content, at, rows = read_frame(source, frame), 0, []
                        while at < len(content):
                            headers, payload, at = parse(content, at)
                            rows.append(_row(headers, payload))
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    names = index.select("bundle").distinct()
    return names.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism), "bundle").mapInArrow(read, _READ_DDL)


_READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _id_of(urn: str) -> int | None:
    text = urn[len("<urn:record:") : -1]
    return int(text) if text else None


def _row(headers: dict[str, str], payload: bytes) -> dict:
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not the one that was written")
    return {
        "page_id": _id_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
        "refers_to": _id_of(headers["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def lookup(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given, each read by seeking its frame: as ``read_bundles``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        last: tuple = ()
        content, frames, source = b"", [], None
        for batch in batches:
            rows = []
            for want in batch.to_pylist():
                if (want["bundle"],) != last[:1]:
                    source = store.open_input_file(f"{root}/{want['bundle']}")
                    frames = seek_table(source)
                if (want["bundle"], want["frame"]) != last:
                    content = read_frame(source, frames[want["frame"]])
                    last = (want["bundle"], want["frame"])
                rows.append(_row(*parse(content[want["offset"] : want["offset"] + want["length"]])[:2]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    dealt = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, _READ_DDL)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes ``pages`` (page_id, url, html) as bundles; (index, records read back, folder).

    A null html is an empty payload, a null url an empty one, a null id an empty record id. Of rows that repeat the least id
    of a payload all are responses. An empty table makes an empty index and no bundle.
    """
    folder = folder or new_folder(spark, "warc")
    index = write_bundles(with_record_types(pages), folder)
    return index, read_bundles(index, folder), folder


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN octet_length(encode(html)) >= {REVISIT_LEAST} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to FROM r
"""
