"""WARC archives that are one gzip stream, rewritten as one member per record.

A crawler that compresses a whole file at once leaves an archive in which no
record can be reached without inflating all before it.  The normaliser inflates
such a stream once, writes every record as a gzip member of its own and beside
the archive a sidecar index of the members' offsets, by which records are then
read one at a time.  On the way, records whose payload another record also has
can become revisits of it.

Every task names what it writes after its own attempt and returns the names; a
table of these, written by Spark, says which archives there are.  What an
attempt that failed has left is in no such table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import chunks, stage, staged_path, text_buffer

ARCHIVE_BYTES = 128 << 20
ARCHIVE_RECORDS = 1 << 16
READ_RECORDS = 1 << 13
READ_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
HEAD_BYTES = 1 << 20
LEVEL = 4
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = re.compile(r"<urn:page:(-?\d*)/.*>")


def digest_of(sha1: bytes) -> str:
    """The bare base32 form that payload digests have."""
    return base64.b32encode(sha1).decode()


def member() -> zlib._Compress:
    """A compressor of one gzip member."""
    return zlib.compressobj(LEVEL, zlib.DEFLATED, 31)


# ---------------------------------------------------------------- writing a crawl


def response_record(record_id: str, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    """A response record with an HTTP head of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "" if url is None else "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url) + "\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id}\r\n{target}WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    return head.encode() + http + payload + END


def write_crawl(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as archives of one gzip stream each.

    ``archive, record, page_id, record_id, digest, bytes``: a row for each
    record, numbered within its archive.  An archive ends at ``archive_bytes``
    of payload or at 65,536 records.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        place, base = pafs.FileSystem.from_uri(path)
        place.create_dir(base, recursive=True)
        number, held, rows, out, packer, name = -1, 0, 0, None, None, ""
        for _, batch in chunks(batches, "html"):
            data, offsets = text_buffer(batch.column(2))
            found: list[tuple] = []
            for i, (page_id, url) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if out is None:
                    number, held, rows, packer = number + 1, 0, 0, member()
                    name = f"{base}/crawl-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.gz"
                    out = place.open_output_stream(name, compression=None)
                payload = data[offsets[i] : offsets[i + 1]].tobytes()
                digest = digest_of(hashlib.sha1(payload).digest())
                record_id = f"<urn:page:{'' if page_id is None else page_id}/{context.partitionId()}-{number}-{rows}>"
                out.write(packer.compress(response_record(record_id, url, payload, digest, date)))
                found.append((name, rows, page_id, record_id, digest, len(payload)))
                rows, held = rows + 1, held + len(payload)
                if held >= archive_bytes or rows == ARCHIVE_RECORDS:
                    out.write(packer.flush())
                    out.close()
                    out = None
            yield table(found, ("archive", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()))
        if out is not None:
            out.write(packer.flush())
            out.close()

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(write, "archive string, record long, page_id long, record_id string, digest string, bytes long")


def table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def revisits_of(records: DataFrame, least: int = 0) -> DataFrame:
    """``archive, revisits``: for each archive the records of it that should
    become revisits, each with the record that it refers to.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest page id stays a response (null ids come last; of equal ids the last
    in the archives).  Only digests and places move: largest ids are combined
    before the shuffle, the join's hot digests are plain rows that Spark may
    split, and an archive's list is bounded by its number of records.
    """
    kept = (
        records.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "archive", "record", "record_id")).alias("kept"))
        .where("n > 1")
        .select("digest", "kept")
    )
    found = records.join(stage(kept, "warc-repeated"), "digest", "left")
    other = (F.col("bytes") >= least) & F.col("kept").isNotNull() & ((F.col("kept.archive") != F.col("archive")) | (F.col("kept.record") != F.col("record")))
    return found.groupBy("archive").agg(F.collect_list(F.when(other, F.struct("record", F.col("kept.record_id").alias("refers_to")))).alias("revisits"))


# ---------------------------------------------------------------- normalising


class Inflated:
    """A gzip file's content, inflated piece by piece as it is asked for.

    The file may have any number of members; where they end means nothing.
    """

    def __init__(self, file: pa.NativeFile):
        self.file, self.buffer, self.pending = file, bytearray(), b""
        self.packed, self.begun = zlib.decompressobj(31), False

    def fill(self) -> bool:
        """Inflate up to a piece more; False at the end."""
        while True:
            if self.packed.eof:
                self.pending, self.packed, self.begun = self.packed.unused_data, zlib.decompressobj(31), False
            data = self.pending or self.file.read(READ_BYTES)
            if not self.begun:  # zeros may pad the file between members
                data = data.lstrip(b"\0") if data[:1] == b"\0" else data
                if not data and self.file.tell() < self.file.size():
                    self.pending = b""
                    continue
            if not data:
                if self.begun:
                    raise ValueError("the gzip stream ends too early")
                return False
            self.begun = True
            piece = self.packed.decompress(data, READ_BYTES)
            self.pending = self.packed.unconsumed_tail
            if piece:
                self.buffer += piece
                return True

    def until(self, mark: bytes, most: int) -> bytes:
        """What comes up to and with ``mark``, or ``most`` bytes if they don't
        hold it, or all that is left if that is less."""
        begin = 0
        while (at := self.buffer.find(mark, begin, most)) < 0 and len(self.buffer) < most:
            begin = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                break
        return self.take(at + len(mark) if at >= 0 else min(most, len(self.buffer)))

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("a record ends too early")
            piece = self.take(min(n, len(self.buffer), READ_BYTES))
            n -= len(piece)
            yield piece


def fields_of(head: bytes) -> tuple[str, list[list[str]]]:
    """The version line and the named fields of a record's or response's head."""
    first, *lines = head.decode("utf-8", "surrogateescape").rstrip("\r\n").split("\r\n")
    fields: list[list[str]] = []
    for line in lines:
        if line[:1] in " \t" and fields:  # a folded line
            fields[-1][1] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            fields.append([name.strip(), value.strip()])
    return first, fields


def field(fields: list[list[str]], name: str, default: str | None = None) -> str | None:
    return next((v for n, v in fields if n.lower() == name), default)


def head_bytes(version: str, fields: list[list[str]]) -> bytes:
    return ("".join([f"{version}\r\n", *(f"{n}: {v}\r\n" for n, v in fields)]) + "\r\n").encode("utf-8", "surrogateescape")


def as_revisit(fields: list[list[str]], refers_to: str, length: int) -> list[list[str]]:
    """A response's fields as those of a revisit that keeps ``length`` bytes."""
    new = {"warc-type": "revisit", "content-length": str(length)}
    kept = [[n, new.get(n.lower(), v)] for n, v in fields if n.lower() not in ("warc-profile", "warc-refers-to", "warc-block-digest")]
    return [*kept[:-1], ["WARC-Profile", PROFILE], ["WARC-Refers-To", refers_to], *kept[-1:]]


def rewrite(source: Inflated, out: pa.NativeFile, revisits: dict[int, str]) -> Iterator[dict]:
    """Write each record of ``source`` as a member; its entry for the index.

    Payloads pass through in pieces and are checked against their digests.
    """
    number = 0
    while True:
        head = source.until(END, HEAD_BYTES)
        while head[:2] == b"\r\n":  # empty lines between records
            head = head[2:] if head != END else source.until(END, HEAD_BYTES)
        if not head:
            return
        version, fields = fields_of(head)
        length = field(fields, "content-length", "")
        if not version.startswith("WARC/") or not head.endswith(END) or not length.isdigit():
            raise ValueError(f"record {number} has no proper head")
        left = int(length)
        http = b""
        if field(fields, "content-type", "").replace(" ", "").lower().startswith("application/http"):
            http = source.until(END, min(left, HEAD_BYTES))
            if len(http) < min(left, HEAD_BYTES) and not http.endswith(END):
                raise ValueError("a record ends too early")
            left -= len(http)
        kind, digest = field(fields, "warc-type"), field(fields, "warc-payload-digest")
        size = left
        if refers_to := revisits.get(number):
            kind, fields = "revisit", as_revisit(fields, refers_to, len(http))
        elif kind == "revisit":  # the crawler's own
            refers_to, size = field(fields, "warc-refers-to"), int(field(fields_of(http)[1], "content-length", "0"))
        begin, packer, sha1 = out.tell(), member(), hashlib.sha1()
        out.write(packer.compress(head_bytes(version, fields) + http))
        for piece in source.pieces(left):
            sha1.update(piece)
            if number not in revisits:
                out.write(packer.compress(piece))
        end = b"".join(source.pieces(len(END)))
        found = digest_of(sha1.digest())
        own = field(fields, "warc-type") != "revisit" or number in revisits
        if end != END or own and digest and digest.startswith("sha1:") and digest[5:] != found:
            raise ValueError(f"record {number} is damaged")
        out.write(packer.compress(END) + packer.flush())
        yield {
            "offset": begin, "length": out.tell() - begin, "type": kind, "record_id": field(fields, "warc-record-id"), "payload_bytes": size,
            "payload_digest": found if own else (digest or "").removeprefix("sha1:"), "refers_to": refers_to,
        }
        number += 1


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite archives (``archive`` and, if there is such a column, its
    ``revisits``) under ``path``: ``archive, source, records, bytes``.

    A stream can be inflated from its start only, so a task has whole archives;
    it holds one record's head and a piece at a time.  The index of an archive
    is beside it, ``.idx.jsonl``: a line for each member.  A damaged stream,
    record or digest is an error that names the archive.
    """
    if "revisits" not in archives.columns:
        archives = archives.select("archive", F.expr("array()").cast("array<struct<record:bigint,refers_to:string>>").alias("revisits"))
    archives = stage(archives.select("archive", "revisits"), "warc-archives")
    # As many tasks as archives: they are few bytes to Spark, which would put them together.
    tasks = max(1, archives.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        place, base = pafs.FileSystem.from_uri(path)
        place.create_dir(base, recursive=True)
        number = 0
        for batch in batches:
            for source, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/records-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.gz"
                number, n = number + 1, 0
                try:
                    with place.open_input_file(source) as file, place.open_output_stream(name, compression=None) as out, place.open_output_stream(f"{name}.idx.jsonl") as index:
                        for n, entry in enumerate(rewrite(Inflated(file), out, {r["record"]: r["refers_to"] for r in revisits}), 1):
                            index.write(json.dumps(entry).encode() + b"\n")
                        size = out.tell()
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{source}: {e}") from e
                yield table([(name, source, n, size)], ("archive", pa.string()), ("source", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()))

    return archives.repartition(tasks).mapInArrow(run, "archive string, source string, records long, bytes long")


# ---------------------------------------------------------------- reading members


def read_member(data: bytes) -> tuple[list[list[str]], list[list[str]], bytes]:
    """The fields, the HTTP fields and the payload of one member."""
    record = zlib.decompress(data, 31)
    at = record.index(END) + len(END)
    _, fields = fields_of(record[:at])
    block = record[at : at + int(field(fields, "content-length"))]
    http: list[list[str]] = []
    if field(fields, "content-type", "").replace(" ", "").lower().startswith("application/http") and (end := block.find(END)) >= 0:
        http, block = fields_of(block[: end + len(END)])[1], block[end + len(END) :]
    return fields, http, block


def read_records(archives: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """All members of the ``archives`` (``archive, records``) under ``path``,
    each read by its offset: ``record_id, type, url, payload_bytes,
    payload_digest, refers_to, payload``.

    Bytes and digest are those of the full payload: counted anew for what is
    stored, as the head says for revisits, whose ``payload`` is null, as it is
    everywhere without ``payloads``.  Archives are dealt out by spans of
    members, so one with very many is read by several tasks.
    """
    spans = F.explode(F.sequence(F.lit(0), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(READ_RECORDS))).alias("first")
    spans = stage(archives.select("archive", spans), "warc-spans")
    kinds = [(n, pa.string()) for n in ("record_id", "type", "url")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with place.open_input_file(f"{name}.idx.jsonl") as index:
                    entries = [json.loads(x) for x in index.read().splitlines()[first : first + READ_RECORDS]]
                rows, held = [], 0
                with place.open_input_file(name) as file:
                    for entry in entries:
                        file.seek(entry["offset"])
                        fields, http, payload = read_member(file.read(entry["length"]))
                        kind, record_id = field(fields, "warc-type"), field(fields, "warc-record-id")
                        size, digest = len(payload), digest_of(hashlib.sha1(payload).digest())
                        if kind == "revisit":
                            size, digest, payload = int(field(http, "content-length", "0")), (field(fields, "warc-payload-digest") or "").removeprefix("sha1:"), None
                        if (record_id, size, digest) != (entry["record_id"], entry["payload_bytes"], entry["payload_digest"]):
                            raise ValueError(f"{name}: the record at {entry['offset']} isn't the index's")
                        rows.append((record_id, kind, field(fields, "warc-target-uri"), size, digest, field(fields, "warc-refers-to"), payload if payloads else None))
                        held += len(payload or b"") if payloads else 256
                        if held >= BATCH_BYTES:
                            yield table(rows, *kinds)
                            rows, held = [], 0
                if rows:
                    yield table(rows, *kinds)

    return spans.repartition(max(1, spans.count())).mapInArrow(run, "record_id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def page_of(record_id: str) -> F.Column:
    """The page id in a column of record ids; null where there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({record_id}, '^<urn:page:(-?[0-9]*)/', 1), '') as bigint)")


def warc_pages(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives of one stream, normalise these and read all
    records back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``.

    A null html is an empty payload; a null url has no target field; null ids
    stay null, and a revisit of such a page refers to null; of repeated rows one
    is the response and the others refer to its id; other columns are ignored.
    An empty table writes no archive and gives no rows.
    """
    path = path or staged_path(pages.sparkSession, "warc")
    records = stage(write_crawl(pages, f"{path}/crawl"), "warc-records")
    archives = stage(normalise(revisits_of(records, least), f"{path}/records"), "warc-manifest")
    read = read_records(archives.where("records > 0"), f"{path}/records", payloads=False)
    return read.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


#: Base32 of a SHA-1 goes by five hexadecimal digits, which are four letters.
WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) h from pages),
r as (select *, row_number() over w n, first_value(page_id) over w kept from p window w as (partition by h order by page_id desc nulls last))
select page_id, cast(payload_bytes as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(h, 1 + cast(i // 4 as int) * 5, 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '') payload_digest,
  case when n = 1 then 'response' else 'revisit' end record_type, case when n > 1 then kept end refers_to from r
"""
