"""Media columns: texts as losslessly stored samples in byte-range-read archives.

Tasks write ZIP archives (stored members) of 8-bit grey images, 64 samples
wide.  A Python data source plans byte ranges over the archive directory; each
range reads the members that begin in it, checks them and, if one can't be
read, tries that one again by its offset.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cachelake.llm.common import chunks, staged_path, text_buffer

WIDTH = 64
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
BATCH_BYTES = 2 << 20
TRIES = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the samples


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_samples(text: bytes) -> bytes:
    """A grey image of the text's bytes, padded by zeros to full rows of 64;
    the unpadded length is kept beside them."""
    rows = max(1, -(-len(text) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    payload = np.zeros(rows * WIDTH, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    lines[:, 1:] = payload.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"tEXt", b"n_bytes\0" + str(len(text)).encode()) + _part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _part(b"IEND", b"")


def decode_samples(media: bytes) -> tuple[bytes, int]:
    """The payload and the unpadded length; raises ValueError if damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("no image")
    at, size, length, packed = 8, (0, 0), -1, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            length = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any() or length < 0:
        raise ValueError("not an image of this kind")
    return lines[:, 1:].tobytes(), length


def features_of(payload: bytes) -> str:
    """Rows, mean, distinct values, entropy and a hash of column means."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    columns = x.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    bits = columns * WIDTH > int(columns.sum())
    mark = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return f"rows={len(x) // WIDTH};mean={int(columns.sum()) / len(x):.4f};values={len(p)};entropy={abs(-(p * np.log2(p)).sum()):.6f};columns={mark:016x}"


# ---------------------------------------------------------------- archives


def write_archives(docs: DataFrame, path: str) -> DataFrame:
    """Store all texts in archives under ``path``; ``archive, members, bytes``.

    An archive's name is its task's and number, and it appears by a rename, so
    that a task that runs twice leaves the same archives as one that runs once.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        place, base = pafs.FileSystem.from_uri(path)
        place.create_dir(base, recursive=True)
        number, members, buffer, archive = 0, 0, io.BytesIO(), None

        def close() -> pa.RecordBatch:
            archive.close()
            name = f"{base}/part-{context.partitionId():06d}-{number:05d}.zip"
            draft = f"{name}.{context.taskAttemptId()}.tmp"
            with place.open_output_stream(draft) as out:
                out.write(buffer.getbuffer())
            place.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members]), pa.array([buffer.tell()])], names=["archive", "members", "bytes"])

        for _, batch in chunks(batches, "text"):
            data, offsets = text_buffer(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if archive is None:
                    members, buffer = 0, io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                media = encode_samples(data[offsets[i] : offsets[i + 1]].tobytes())
                archive.writestr(zipfile.ZipInfo(f"{members}/{'' if doc_id is None else doc_id}.png"), media)
                members += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield close()
                    number, archive = number + 1, None
        if archive is not None:
            yield close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(write, "archive string, members long, bytes long")


class Range(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveReader(DataSourceReader):
    """Plans byte ranges from names and sizes alone; members are found by the
    tasks, in each archive's own directory."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        place, base = pafs.FileSystem.from_uri(self.path)
        files = place.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.is_file and f.path.endswith(".zip"))
        return [Range(p, n, at, min(n, at + self.range_bytes)) for p, n in found for at in range(0, n, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        place, _ = pafs.FileSystem.from_uri(self.path)
        with place.open_input_file(partition.archive) as file:
            members = [m for m in directory(file, partition.size) if partition.start <= m[1] < partition.end]
            rows: list[tuple] = []
            held = 0
            for name, offset, length, crc in members:
                media = self._member(place, file, partition.archive, name, offset, length, crc)
                rows.append((partition.archive, name, offset, media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _member(self, place: pafs.FileSystem, file: pa.NativeFile, archive: str, name: str, offset: int, length: int, crc: int) -> bytes:
        """One member's bytes; a failed read is tried again, of this member
        alone and with the file opened anew."""
        for n in range(TRIES):
            try:
                if n == 0:
                    return read_member(file, offset, length, crc)
                with place.open_input_file(archive) as again:
                    return read_member(again, offset, length, crc)
            except (OSError, ValueError) as e:
                if n == TRIES - 1:
                    raise OSError(f"{archive}: member {name} at {offset}: {e}") from e
                time.sleep(0.1 * 2**n)
        raise AssertionError


def directory(file: pa.NativeFile, size: int) -> list[tuple[str, int, int, int]]:
    """``name, offset, length, crc`` of an archive's stored members."""
    n = min(size, 22 + 65535)
    file.seek(size - n)
    tail = file.read(n)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no archive directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    file.seek(start)
    entries, out, at = file.read(length), [], 0
    while at < len(entries):
        method, crc, packed, name_n, extra_n, comment_n, offset = *struct.unpack_from("<H", entries, at + 10), *struct.unpack_from("<II", entries, at + 16), *struct.unpack_from("<HHH", entries, at + 28), *struct.unpack_from("<I", entries, at + 42)
        if method:
            raise ValueError("a packed member")
        out.append((entries[at + 46 : at + 46 + name_n].decode(), offset, packed, crc))
        at += 46 + name_n + extra_n + comment_n
    return out


def read_member(file: pa.NativeFile, offset: int, length: int, crc: int) -> bytes:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member here")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + name_n + extra_n)
    media = file.read(length)
    if len(media) != length or zlib.crc32(media) != crc:
        raise ValueError("a damaged member")
    return media


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "position", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, position long, media binary"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("rangebytes", str(range_bytes)).load(path)


def media_digest(media: DataFrame) -> DataFrame:
    """Digests and features of stored members, each read and decoded whole."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = stored.as_py()
                payload, n = decode_samples(raw)
                doc_id = member.rpartition("/")[2].removesuffix(".png")
                rows.append((int(doc_id) if doc_id else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), features_of(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("member", "media").mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text as media and return what reading it back shows.

    Null and empty texts are one row of 64 zero bytes; repeated rows are
    members of their own with equal values; a null id stays null; other columns
    are ignored.  An empty table writes no archive and gives no rows.
    """
    spark = docs.sparkSession
    path = path or staged_path(spark, "media")
    place, base = pafs.FileSystem.from_uri(path)
    place.create_dir(base, recursive=True)
    write_archives(docs, path).agg(F.sum("members")).collect()  # one number
    return media_digest(read_archives(spark, path))
