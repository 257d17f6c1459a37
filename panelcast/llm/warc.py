"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each with several records, and a seek table in a
skippable frame at its end. An index maps record keys to a frame and an offset inside it, so one record
is read with one range request. Payloads that occur again are written once and revisited.

The forecasting project has no web captures, so the operators are general: any table with a key, an
address and a payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_rows, limit_batches, null_safe_join, pieces, saved, small_batches
from panelcast.operators.storage import qualified

BUNDLE_BYTES = 32_000_000
FRAME_BYTES = 256_000
DATE = "2000-01-01T00:00:00Z"

# The seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
SEEK_FOOTER, SEEK_FOOTER_BYTES = "<IBI", 9
SEEK_ENTRY, SEEK_ENTRY_BYTES = "<II", 8

# The WARC layout.
HEAD_END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"

INDEX_TYPE = (
    "key long, bundle string, frame int, frame_start long, frame_bytes long, frame_offset long, record_bytes long"
)
RECORD_TYPE = (
    "key long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _record(key, uri, payload: bytes, digest: str, size: int, top: tuple | None, ordinal: int, date: str) -> bytes:
    """One record; ``top`` is the (key, uri) of the response that a revisit refers to."""

    def name(of, address, nth):
        said = hashlib.sha256(f"{of}|{address}|{digest}|{nth}".encode()).digest()
        return f"<urn:uuid:{uuid.UUID(bytes=said[:16], version=4)}>"

    block = HTTP + HEAD_END + (payload if top is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if top is None else 'revisit'}",
        f"WARC-Record-ID: {name(key, uri, ordinal)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if key is not None:
        head.append(f"Record-Key: {key}")
    if top is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(*top, 0)}",
        ]
        if top[0] is not None:
            head.append(f"Refers-To-Key: {top[0]}")
    return "\r\n".join(head).encode() + HEAD_END + block + HEAD_END


def parse_records(data: bytes) -> Iterator[tuple]:
    """Rows of ``RECORD_TYPE`` from the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(HEAD_END, at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + len(HEAD_END)
        at = start + int(head["Content-Length"])
        block = data[start:at]
        at += len(HEAD_END)
        kind = head["WARC-Type"]
        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
        payload = block.split(HEAD_END, 1)[1] if kind == "response" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = number("Payload-Length")
        if payload is not None and (len(payload), base32_sha1(payload)) != (size, digest):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
        yield (
            number("Record-Key"), head.get("WARC-Target-URI"), kind, size, digest, number("Refers-To-Key"), payload,
        )


class _Bundle:
    """Writes one file: frames as records come, then the seek table."""

    def __init__(self, folder: str, number: int, frame_bytes: int, level: int):
        self.store, path = _place(folder)
        self.name = f"bundle-{number:08d}.warc.zst"
        self.path, self.part = f"{path}/{self.name}", f"{path}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.records: list[tuple] = []
        self.raw = bytearray()
        self.frames: list[tuple[int, int]] = []
        self.at = 0

    def add(self, key, record: bytes) -> list[tuple]:
        self.records.append((key, len(self.raw), len(record)))
        self.raw += record
        return self.flush() if len(self.raw) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.records:
            return []
        frame = self.pack.compress(bytes(self.raw))
        self.out.write(frame)
        rows = [(k, self.name, len(self.frames), self.at, len(frame), o, n) for k, o, n in self.records]
        self.frames.append((len(frame), len(self.raw)))
        self.at += len(frame)
        self.records, self.raw = [], bytearray()
        return rows

    def close(self) -> list[tuple]:
        """The file gets its name only when it is whole, so a task that is run again replaces it."""
        rows = self.flush()
        table = b"".join(struct.pack(SEEK_ENTRY, *f) for f in self.frames)
        table += struct.pack(SEEK_FOOTER, len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.store.move(self.part, self.path)
        return rows


def seek_table(file: io.RawIOBase, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, raw bytes) of every frame, from the end of the file."""
    file.seek(size - SEEK_FOOTER_BYTES)
    count, _, magic = struct.unpack(SEEK_FOOTER, file.read(SEEK_FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - SEEK_FOOTER_BYTES - count * SEEK_ENTRY_BYTES)
    frames, at = [], 0
    for packed, raw in struct.iter_unpack(SEEK_ENTRY, file.read(count * SEEK_ENTRY_BYTES)):
        frames.append((at, packed, raw))
        at += packed
    return frames


def write_bundles(
    df: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0,
    bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, level: int = 3, date: str = DATE,
) -> DataFrame:
    """Write one record per row into bundles below ``folder`` (on a store that pyarrow and all executors
    reach) and return the index, which is also written there as ``index``.

    General: the forecasting project has no web captures. Of equal payloads of at least ``min_bytes`` bytes, the row with the largest key (then address) becomes
    the response and the others revisit it; exact repeats of a row count as others. Null payloads are
    empty, null keys come before all others and are left out of the header; other columns are ignored. An
    empty table gives no bundles and an empty index. A payload that a third of all rows share costs one row
    of the table of responses, which is written first: Spark broadcasts it if its files are small, and
    otherwise sorts and merges. A bundle is written as it streams by and appears only when it is whole.
    """
    spark, folder = df.sparkSession, qualified(df.sparkSession, folder)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("body")
    ).withColumns({"same": F.unhex(F.sha2("body", 256)), "size": F.octet_length("body").cast("long")})
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundles = pieces(total, bundle_bytes)
    repeated = saved(
        rows.where(F.col("size") >= min_bytes)
        .groupBy("same")
        .agg(F.max(F.struct("key", "uri")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "responses",
    )
    decided = (
        null_safe_join(rows, repeated, ["same"])
        .withColumn("again", F.col("top").isNotNull() & ~F.struct("key", "uri").eqNullSafe(F.col("top")))
        .withColumn("digest", F.unhex(F.sha1("body")))
        .withColumn("body", F.when(~F.col("again"), F.col("body")))
        .withColumn("bundle", F.pmod(F.xxhash64("key", "uri", "same"), F.lit(bundles)))
        .select("bundle", "key", "uri", "same", "digest", "size", "again", "top.*", "body")
        .toDF("bundle", "key", "uri", "same", "digest", "size", "again", "top_key", "top_uri", "body")
        .repartitionById(bundles, F.col("bundle").cast("int"))
        .sortWithinPartitions("bundle", "key", "uri", "same")
    )

    limit_batches(df.sparkSession)
    def write(batches):
        store, path = _place(folder)
        store.create_dir(path, recursive=True)
        bundle, number, before, ordinal = None, None, None, 0
        for batch in small_batches(batches, 256):
            out = []
            for row in batch.to_pylist():
                if row["bundle"] != number:
                    if bundle:
                        out += bundle.close()
                    number = row["bundle"]
                    bundle = _Bundle(folder, number, frame_bytes, level)
                now = (row["key"], row["uri"], row["same"])
                ordinal = ordinal + 1 if now == before else 0
                before = now
                top = (row["top_key"], row["top_uri"]) if row["again"] else None
                if top is None and ordinal and row["size"] >= min_bytes:
                    top = now[:2]
                digest = base64.b32encode(row["digest"]).decode()
                record = _record(
                    row["key"], row["uri"], row["body"] or b"", digest, row["size"], top, ordinal, date
                )
                out += bundle.add(row["key"], record)
            yield arrow_rows(out, INDEX_TYPE)
        if bundle:
            yield arrow_rows(bundle.close(), INDEX_TYPE)

    decided.mapInArrow(write, INDEX_TYPE).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst")
        .load(qualified(spark, folder)).select("path", "length")
    )


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles below ``folder``, frame by frame as their seek tables say, digests checked."""

    def read(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _place(path)
                with store.open_input_file(place) as file:
                    for start, packed, raw in seek_table(file, length):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
                        rows = parse_records(data)
                        yield arrow_rows([r if payloads else (*r[:-1], None) for r in rows], RECORD_TYPE)

    if not spark.read.parquet(f"{qualified(spark, folder)}/index").take(1):
        return spark.createDataFrame([], RECORD_TYPE)
    return _bundles(spark, folder).mapInArrow(read, RECORD_TYPE)


def read_records(index: DataFrame, folder: str, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The records whose key is in ``wanted``: one range read per frame that holds any of them."""
    folder = qualified(index.sparkSession, folder)
    hits = index.join(wanted.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    placed = hits.repartition("bundle").sortWithinPartitions("bundle", "frame", "frame_offset")

    def read(batches):
        name, frame, data, file = None, None, b"", None
        for batch in small_batches(batches):
            out = []
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    store, path = _place(folder)
                    name, frame, file = row["bundle"], None, store.open_input_file(f"{path}/{row['bundle']}")
                if row["frame"] != frame:
                    frame = row["frame"]
                    file.seek(row["frame_start"])
                    data = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"]))
                start = row["frame_offset"]
                out += parse_records(data[start : start + row["record_bytes"]])
            yield arrow_rows(out, RECORD_TYPE)

    return placed.mapInArrow(read, RECORD_TYPE)
