"""WARC archives with one zstandard frame a record and the dictionary in a leading skippable frame.

The first frame of an archive is skippable (magic 0x184D2A5D) and holds the dictionary, itself
compressed or plain; every following frame is one record. Readers take the dictionary from there,
decode a frame at a time and check version, named fields, block length, digests and the HTTP length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, materialise, one_task_each, scratch_path, to_batch

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = 0x184D2A50, 0x184D2A5F
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN_AT = "2024-01-01T00:00:00Z"
#: Payloads from which an equal one is written as a revisit.
REVISIT_FROM = 100
#: Bytes of an archive after which the next begins; dictionary, and what it is trained on.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, TRAINING_BYTES = 32 << 10, 2 << 20


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", WRITTEN_AT),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_urn(refers_to))] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.fields["warc-type"]

    def page_id(self, name: str = "warc-record-id") -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d*)>", self.fields.get(name, ""))
        if not m:
            raise ArchiveError(f"{name} names no page")
        return int(m[1]) if m[1] else None

    def http(self) -> tuple[dict[str, str], bytes]:
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise ArchiveError("the block is no HTTP message")
        return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"a header line without a name: {line[:60]!r}")
        key = name.decode("ascii", "replace").lower()
        if key in out and key != "warc-concurrent-to":
            raise ArchiveError(f"{key} occurs twice")
        out[key] = value.strip().decode("utf-8")
    return out


def parse_record(data: bytes) -> Record:
    """One record, with its header, lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC version line")
    fields = _fields(lines[1:])
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ArchiveError(f"no {needed}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise ArchiveError("content-length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, the header says {n}")
    record = Record(fields, rest[:n])
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(record.block).hexdigest():
        raise ArchiveError("the block fails its digest")
    if fields["warc-type"] == "response":
        http, body = record.http()
        if int(http.get("content-length", len(body))) != len(body):
            raise ArchiveError("the payload is not as long as the HTTP header says")
        if fields.get("warc-payload-digest", "").startswith("sha256:") and fields["warc-payload-digest"][7:] != hashlib.sha256(body).hexdigest():
            raise ArchiveError("the payload fails its digest")
    elif fields["warc-type"] == "revisit":
        if "warc-refers-to" not in fields or "warc-payload-digest" not in fields:
            raise ArchiveError("a revisit that refers to nothing")
        record.http()
    return record


class ArchiveWriter:
    """Writes records as frames behind the dictionary's frame."""

    def __init__(self, out, samples: list[bytes], level: int = 3):
        self.out, self.size, self.records = out, 0, 0
        dictionary = None
        if len(samples) >= 8:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
            except zstandard.ZstdError:
                pass  # too little to learn from: an archive needs no dictionary
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[Record]:
    """The records of an archive, one frame each; `stream` needs read(n)."""
    held = stream.read(chunk)
    while held and len(held) < 8 and (more := stream.read(chunk)):
        held += more
    dictionary = None
    if len(held) >= 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", held[4:8])[0]
        while len(held) < 8 + size:
            more = stream.read(chunk)
            if not more:
                raise ArchiveError("the dictionary's frame is cut off")
            held += more
        content, held = held[8 : 8 + size], held[8 + size :]
        if content[:4] == struct.pack("<I", FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        while len(held) < 8 and (more := stream.read(chunk)):
            held += more
        if not held:
            return
        if len(held) >= 8 and SKIPPABLE[0] <= struct.unpack("<I", held[:4])[0] <= SKIPPABLE[1]:
            # Any other skippable frame is none of ours.
            over = 8 + struct.unpack("<I", held[4:8])[0]
            while over > len(held):
                over, held = over - len(held), stream.read(chunk)
                if not held:
                    raise ArchiveError("a skippable frame is cut off")
            held = held[over:]
            continue
        frame = unpacker.decompressobj()
        parts = []
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = stream.read(chunk)
                if not held:
                    raise ArchiveError("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a frame can't be decoded: {e}") from e
        yield parse_record(b"".join(parts))  # an empty frame is no record


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Each page with its digest and, for a revisit, the page it refers to.

    Of equal payloads of at least REVISIT_FROM bytes the one with the smallest id (null: last) is the
    response; among rows with that id, one. Only digests are shuffled to find it; the payloads are
    moved once, by id and digest, so copies of one payload spread over the tasks.
    """
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = F.coalesce("page_id", F.lit((1 << 63) - 1))
    rows = rows.withColumn("known", known)
    narrow = rows.filter(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest", "known").agg(F.count("*").alias("n"))
    first = narrow.groupBy("digest").agg(F.min("known").alias("first_id"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    repeated = narrow.drop("n").join(first, "digest")
    joined = rows.join(repeated, ["digest", "known"], "left")
    twin = F.row_number().over(Window.partitionBy("digest", "known").orderBy("url"))
    revisit = F.col("first_id").isNotNull() & ((F.col("known") != F.col("first_id")) | (twin > 1))
    return joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit") & (F.col("first_id") != (1 << 63) - 1), F.col("first_id"))).select("page_id", "url", "payload", "digest", "revisit", "refers_to")


ARCHIVES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records; returns the archives that finished tasks report: path, records, bytes."""
    bounded_batches(decided.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = writer = None
        rows: list[list] = []

        def close() -> None:
            if writer is not None:
                out.close()
                rows[-1][1:] = [writer.records, writer.size]

        for batch in batches:
            records = [
                make_record(page_id, url, payload, digest, refers_to, revisit)
                for page_id, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            for i, record in enumerate(records):
                if writer is None or writer.size >= ARCHIVE_BYTES:
                    close()
                    samples, room = [], TRAINING_BYTES
                    for sample in records[i:]:
                        if len(sample) <= room:
                            samples.append(sample)
                            room -= len(sample)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    rows.append([f"{folder}/{name}", 0, 0])
                    writer = ArchiveWriter(out, samples)
                writer.add(record)
        if rows:
            close()
            yield to_batch([tuple(r) for r in rows], ARCHIVES)

    made = decided.select("page_id", "url", "payload", "digest", "revisit", "refers_to").mapInArrow(write, "path string, records long, bytes long")
    return materialise(made, "archives")


PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives; any that breaks the format fails the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, at = filesystem(path)
                rows, n = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for record in read_archive(stream):
                        n += 1
                        http, body = record.http()
                        revisit = record.kind == "revisit"
                        size = int(http["content-length"]) if revisit else len(body)
                        digest = record.fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                        rows.append((record.page_id(), size, digest, record.kind, record.page_id("warc-refers-to") if revisit else None))
                        if len(rows) >= 4096:
                            yield to_batch(rows, PAGES)
                            rows = []
                if n != expected:
                    raise ArchiveError(f"{path} has {n} records, not {expected}")
                if rows:
                    yield to_batch(rows, PAGES)

    return one_task_each(archives.select("path", "records"), "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write a record for each page into archives in the shared folder and read them back.

    Null payloads and urls are empty. An empty table gives no archive and no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(decide(pages), folder))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), d AS (
  SELECT page_id, n, sha256(payload) AS digest,
         min(page_id) OVER (PARTITION BY sha256(payload)) AS first_id,
         row_number() OVER (PARTITION BY sha256(payload) ORDER BY page_id) AS k
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN first_id END AS refers_to
FROM d
"""
