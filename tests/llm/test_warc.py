"""The gzip normaliser: round trips, revisits, streams of any shape."""

import base64
import gzip
import hashlib
import io
import json
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyarrow import fs as pafs

from cachelake.llm import warc
from cachelake.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (7, None, "<p>one</p>"), (3, "http://a/ 3\r\nX: y", ""), (4, "u", None), (5, "é", "ü ß \r\n\r\n 　"),
    (6, "u", "long " * 300_000), (8, "u", "long " * 300_000), (9, "", "once"), (9, "", "once"), (9, "", "once too"), (None, None, None), (None, "x", "alone"), (None, "y", "nobody"), (None, "z", "nobody"),
]


def plain(rows, least=0):
    """What the operator should return, by a dictionary."""
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, i))
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kept = max(members)
        for m in members:
            again = m != kept and len(payload) >= least
            page = lambda m: m[1] if m[0] else None
            out.append((page(m), len(payload), digest, "revisit" if again else "response", page(kept) if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_pages(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'own' archive", "1 record", "'x' digest", "2L bytes", "'r' revisits", "'k' kept").repartition(3)
    for least in (0, 5, 10):
        assert rows_of(warc.warc_pages(df, least)) == plain(PAGES, least)
    assert warc.warc_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    want = duckdb.connect().execute(ORACLE_SQL["op11_warc"].replace("from pages)", f"from '{sf_dir}/pages.parquet')"))
    got = QUERIES["op11_warc"](spark, sf_dir)
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == sorted(want.fetchall(), key=str)


def test_one_payload_that_a_third_of_the_pages_have(spark):
    rows = [(i, f"http://p/{i}", "not found" if i % 3 == 0 else f"page {i % 400}") for i in range(3000)]
    assert rows_of(warc.warc_pages(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def record(n, payload, kind="response", more=""):
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\n{more}Content-Type: application/http; msgtype={kind}\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n".encode() + http + payload + b"\r\n\r\n"


def normal(data, revisits=None):
    sink = pa.BufferOutputStream()
    entries = list(warc.rewrite(warc.Inflated(pa.BufferReader(data)), sink, revisits or {}))
    return sink.getvalue().to_pybytes(), entries


def test_streams_of_any_shape_give_the_same_members(monkeypatch):
    rng = random.Random(5)
    payloads = [b"", b"a", b"\r\n\r\n" * 9, rng.randbytes(70_000), b"x" * 5_000_000, b"end"]
    records = [record(i, p) for i, p in enumerate(payloads)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    whole = info + b"".join(records)
    cuts = sorted(rng.randrange(len(whole)) for _ in range(5))
    shapes = [gzip.compress(whole), b"".join(gzip.compress(r) for r in [info, *records]), b"".join(gzip.compress(whole[a:b]) for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)), gzip.compress(whole) + bytes(5000), gzip.compress(b"\r\n\r\n" + whole)]
    first = normal(shapes[0])
    for size in (1 << 20, 4096):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        for shape in shapes:
            assert normal(shape) == first
    data, entries = first
    assert [e["type"] for e in entries] == ["warcinfo"] + ["response"] * 6 and entries[-1]["offset"] + entries[-1]["length"] == len(data)
    for e, p in zip(entries[1:], payloads, strict=True):  # each member by itself
        packed = zlib.decompressobj(31)
        assert packed.decompress(data[e["offset"] : e["offset"] + e["length"]]).endswith(p + b"\r\n\r\n") and packed.eof and not packed.unused_data
        assert warc.read_member(data[e["offset"] : e["offset"] + e["length"]])[2] == p and e["payload_bytes"] == len(p)
    assert normal(data) == first  # already normal


def test_revisits_keep_the_full_payloads_size_and_digest():
    payload = b"payload " * 50
    data, entries = normal(gzip.compress(record(0, payload) + record(1, payload) + record(2, b"", "revisit", "WARC-Refers-To: <urn:x:0>\r\nWARC-Payload-Digest: sha1:ABC\r\n")), {1: "<urn:x:0>"})
    assert [(e["type"], e["refers_to"], e["payload_bytes"]) for e in entries] == [("response", None, 400), ("revisit", "<urn:x:0>", 400), ("revisit", "<urn:x:0>", 0)]
    assert entries[1]["payload_digest"] == entries[0]["payload_digest"] and entries[2]["payload_digest"] == "ABC"
    fields, http, kept = warc.read_member(data[entries[1]["offset"] :][: entries[1]["length"]])
    assert not kept and warc.field(http, "content-length") == "400" and warc.field(fields, "warc-refers-to") == "<urn:x:0>" and warc.field(fields, "warc-profile") == warc.PROFILE


@pytest.mark.parametrize("damage", [lambda b: gzip.compress(b)[:-9], lambda b: gzip.compress(b[:-20]), lambda b: gzip.compress(b.replace(b"Content-Length: 7", b"Content-Lengt: 7")), lambda b: gzip.compress(b.replace(b"payload ", b"payl0ad ", 1)), lambda b: gzip.compress(b"no archive" + b)])
def test_damage_is_an_error(damage):
    payload = b"payload " * 4
    digest = f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\n"
    good = record(0, payload, more=digest)
    assert len(normal(gzip.compress(good))[1]) == 1
    with pytest.raises((ValueError, zlib.error)):
        normal(damage(good))


def test_archives_from_elsewhere(spark, tmp_path):
    names = []
    for i in range(3):
        names.append((f"{tmp_path}/in{i}.warc.gz",))
        with open(names[-1][0], "wb") as f:
            f.write(gzip.compress(b"".join(record(f"{i}-{n}", f"text {n}".encode()) for n in range(20 * i))))
    path = f"file://{tmp_path}/out"
    found = warc.stage(warc.normalise(spark.createDataFrame(names, "archive string"), path), "test-manifest")
    assert sorted(r.records for r in found.collect()) == [0, 20, 40]
    place, _ = pafs.FileSystem.from_uri(path)
    for r in found.collect():
        with place.open_input_file(f"{r.archive}.idx.jsonl") as f:
            assert [json.loads(x)["record_id"].split("-")[1] for x in io.BytesIO(f.read())] == [f"{n}>" for n in range(r.records)]
    got = {r.record_id: bytes(r.payload) for r in warc.read_records(found.where("records > 0"), path).collect()}
    assert got == {f"<urn:x:{i}-{n}>": f"text {n}".encode() for i in range(3) for n in range(20 * i)}
