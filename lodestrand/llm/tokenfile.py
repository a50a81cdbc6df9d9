"""Token-id files: one zstandard frame a document, a trailing seek table, a checksum for each frame.

Layout of a file (the public seekable format of zstandard):

* frame i < n: the ids of document i, little-endian unsigned, 2 bytes each if the vocabulary fits
  them and else 4;
* frame n: the directory: magic, id width, n, then n doc_ids, a null mark each and n token counts;
* a skippable frame (magic 0x184D2A5E) with one entry a frame (compressed size, decompressed size,
  low 32 bits of XXH64 of the content) and the footer (number of frames, descriptor with the
  checksum flag, magic 0x8F92EAB1).

A reader fetches the footer, the directory and then only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, id_text, materialise, one_task_each, scratch_path, to_batch
from .tokenise import encoder

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
DIRECTORY = b"LDTOKEN1"
#: Bytes of compressed frames after which a task starts its next file.
FILE_BYTES = 128 << 20


class SeekableError(ValueError):
    """A token file that is damaged or is none."""


def frame_checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class SeekableWriter:
    """Writes frames to an open file and the seek table at the end."""

    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.size = out, width, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.out.write(packed)
        self.size += len(packed)
        self.entries.append((len(packed), len(content), frame_checksum(content)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self._frame(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)

    def close(self) -> None:
        n = len(self.ids)
        self._frame(
            DIRECTORY
            + struct.pack("<II", self.width, n)
            + np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
            + bytes(i is None for i in self.ids)
            + np.array(self.counts, "<i8").tobytes()
        )
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class SeekableReader:
    """Reads chosen documents of a token file through `read(offset, length)`."""

    def __init__(self, read, size: int):
        self.read = read
        if size < 17:
            raise SeekableError("too short for a seek table")
        frames, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUM_FLAG or not frames:
            raise SeekableError("no seek table with checksums at the end")
        start = size - 17 - 12 * frames
        head = read(start, 8) if start >= 0 else b"\0" * 8
        if struct.unpack("<II", head) != (SKIPPABLE, 12 * frames + 9):
            raise SeekableError("the seek table's frame does not fit its footer")
        table = np.frombuffer(read(start + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.lengths, self.sums = table.T
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        if self.offsets[-1] != start:
            raise SeekableError("the frames do not end at the seek table")
        self.unpacker = zstandard.ZstdDecompressor()
        directory = self.frame(frames - 1)
        if directory[:8] != DIRECTORY:
            raise SeekableError("no directory in the last frame")
        self.width, n = struct.unpack("<II", directory[8:16])
        if n != frames - 1 or len(directory) != 16 + 17 * n:
            raise SeekableError("the directory does not fit the seek table")
        ids = np.frombuffer(directory, "<i8", n, 16)
        nulls = directory[16 + 8 * n : 16 + 9 * n]
        self.ids = [None if gone else int(i) for i, gone in zip(ids, nulls, strict=True)]
        self.counts = np.frombuffer(directory, "<i8", n, 16 + 9 * n)

    def frame(self, k: int, packed: bytes | None = None) -> bytes:
        packed = packed or self.read(int(self.offsets[k]), int(self.sizes[k]))
        try:
            content = self.unpacker.decompress(packed, max_output_size=int(self.lengths[k]) or 1)
        except zstandard.ZstdError as e:
            raise SeekableError(f"frame {k}: {e}") from e
        if len(content) != self.lengths[k] or frame_checksum(content) != self.sums[k]:
            raise SeekableError(f"frame {k} fails its checksum")
        return content

    def document(self, k: int, packed: bytes | None = None) -> np.ndarray:
        """The ids of the k-th document, as little-endian unsigned 32-bit."""
        return np.frombuffer(self.frame(k, packed), f"<u{self.width}").astype("<u4")


MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("first_tie", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest of the files.

    Nulls: a null text is empty, null ids come first. Rows with one id are ordered by a hash of
    their text; equal rows are interchangeable. Each task writes files named by its attempt, and only
    those that a finished task reports are in the manifest, so a repeated task leaves no duplicate.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    spread = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = 2 if encode.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = writer = None
        rows: list[list] = []
        for batch in batches:
            for doc_id, text, tie in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tie")), strict=True):
                if writer is None or writer.size >= FILE_BYTES:
                    if writer is not None:
                        writer.close()
                        out.close()
                    name = f"{uuid.uuid4().hex}.tok.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    writer = SeekableWriter(out, width)
                    rows.append([f"{folder}/{name}", doc_id, tie, 0, 0])
                ids = encode.encode(text) + end
                writer.add(doc_id, ids)
                rows[-1][3] += 1
                rows[-1][4] += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            yield to_batch([tuple(r) for r in rows], MANIFEST)

    made = spread.mapInArrow(write, "path string, first_id long, first_tie long, documents long, tokens long")
    manifest = materialise(made, "token-manifest")
    # One row a file of up to FILE_BYTES: the only step that one task does alone.
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_tie", "path")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _open(path: str):
    fs, at = filesystem(path)
    source = fs.open_input_file(at)
    return source, SeekableReader(lambda offset, n: source.read_at(n, offset), source.size())


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files, in their order: doc_id, start, n_tokens, ids_crc32.

    Files are read a span of frames at a time; each frame's checksum is verified.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                source, reader = _open(path)
                with source:
                    rows, n, k = [], len(reader.ids), 0
                    while k < n:
                        last = max(k + 1, int(np.searchsorted(reader.offsets[: n + 1], reader.offsets[k] + (4 << 20), "right")) - 1)
                        base = int(reader.offsets[k])
                        span = reader.read(base, int(reader.offsets[last]) - base)
                        for j in range(k, last):
                            at = int(reader.offsets[j]) - base
                            ids = reader.document(j, span[at : at + int(reader.sizes[j])])
                            if len(ids) != reader.counts[j]:
                                raise SeekableError(f"{path}: document {j} has {len(ids)} ids, not {reader.counts[j]}")
                            rows.append((reader.ids[j], start, len(ids), zlib.crc32(ids.tobytes())))
                            start += len(ids)
                        k = last
                        if len(rows) >= 4096:
                            yield to_batch(rows, READ)
                            rows = []
                    if rows:
                        yield to_batch(rows, READ)

    files = manifest.select("path", "start")
    return one_task_each(files, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, wanted: Iterable[int | None]) -> dict[int | None, np.ndarray]:
    """Decompress only the wanted documents of one file."""
    wanted = set(wanted)
    source, reader = _open(path)
    with source:
        return {i: reader.document(k) for k, i in enumerate(reader.ids) if i in wanted}


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back.

    An empty table gives no rows; an empty text is its end id alone.
    """
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, end_id, folder))
