import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cachelake.llm import media
from cachelake.llm.license_scan import TEMPLATES, license_scan, patience, scan_words
from cachelake.llm.media import decode_samples, encode_samples, media_columns, read_archives, write_archives
from cachelake.llm.topk import TOP_K_SQL, KDTree, search, top_k

from .cases import AWKWARD, awkward, empty


def test_top_k_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({TOP_K_SQL})").fetchall())
    got = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_trees_are_exact():
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(0, 8, (3000, 6)))
    points[::5] = points[0]  # ties
    ids = rng.permutation(3000) // 2
    queries = np.concatenate([points[:20], np.round(rng.normal(0, 8, (20, 6)))])
    tree = KDTree(points, 16)
    own = np.concatenate([np.arange(20), np.full(20, -1)])
    asker, score, found = search(tree, ids[tree.order], tree.order, queries, own, np.full(40, -(2**63) + 1), 10)
    for q in range(40):
        s = points @ queries[q]
        order = [i for i in np.lexsort((ids, -s)) if i != own[q]][:10]
        assert found[asker == q].tolist() == ids[order].tolist() and score[asker == q].tolist() == s[order].tolist()
    leaf = tree.leaf_of(points)
    assert leaf.max() < sum(n[2] < 0 for n in tree.nodes) and len(np.unique(leaf)) > 100


def test_clustered_shards_are_ruled_out_before_the_shuffle(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 4, (16, 8))
    rows = [(i, (centre[i % 16] + rng.normal(0, 0.1, 8)).tolist()) for i in range(1600)] + [(40, centre[0].tolist()), (40, centre[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, "vec_id % 20 = 0", k=5, shard_rows=100).collect()))
    v, ids = np.floor(64 * np.array([r[1] for r in rows])), np.array([r[0] for r in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        want += [(ids[q], n + 1, ids[i], int(s[i])) for n, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:5])]
    assert got == sorted(want)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (40, [1.0]), (6, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 5, 4096), (0, 2, 5, 4096), (0, 3, 20, 2048), (20, 1, 5, 4096), (20, 2, 5, 4096), (20, 3, 0, 2048), (40, 1, 6, 8192)]
    assert top_k(df.where("false"), "true").count() == 0


def test_samples_round_trip():
    for text in (b"", b"a", b"x" * 64, bytes(range(256)) * 9, "é\n".encode() * 1000):
        payload, n = decode_samples(encode_samples(text))
        assert n == len(text) and payload[:n] == text and len(payload) % 64 == 0 and len(payload) >= 64 and not any(payload[n:])
    with pytest.raises(ValueError):
        decode_samples(encode_samples(b"abc")[:-20] + b"x" * 20)


def test_media_of_awkward_rows(spark):
    got = sorted(((r.doc_id or -1), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_columns(awkward(spark)).collect())
    want = []
    for i, t, *_ in AWKWARD:
        b = (t or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        want.append((i or -1, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert media_columns(empty(spark)).count() == 0


def test_members_are_read_once_whatever_the_ranges(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/archives"
    assert sum(r.members for r in write_archives(docs, path).collect()) == 300
    for size in (1 << 30, 3000, 400):
        assert sorted(r[0] for r in read_archives(spark, path, size).selectExpr("split_part(split_part(member,'/',2),'.',1) d").collect()) == sorted(str(i) for i in range(300))
    # A member that fails is tried again by itself.
    reader, tries = media.ArchiveReader({"path": path}), []
    plain = media.read_member

    def flaky(file, offset, length, crc):
        tries.append(offset)
        if tries.count(offset) == 1 and offset > 0:
            raise OSError("lost")
        return plain(file, offset, length, crc)

    monkeypatch.setattr(media, "read_member", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda _: None)
    part = reader.partitions()[0]
    n = sum(b.num_rows for b in reader.read(part))
    assert n > 1 and len(tries) == 2 * n - 1


def test_patience():
    text, template = "a x b c d e b".split(), "a b c q d e".split()
    assert [text[i] for i, _ in patience(text, template)] == list("abcde")
    rng = random.Random(4)
    for _ in range(200):
        t, p = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = patience(t, p)
        assert all(t[i] == p[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_licenses_are_found(spark):
    filler = " ".join(f"word{i} the of and" for i in range(300))
    rows = [(i, f"{filler}\n{t}\n{filler}", n) for i, (n, t) in enumerate(TEMPLATES.items())]
    rows += [(100, filler, None), (101, None, None), (102, "", None), (None, TEMPLATES["MIT text"].replace("merge", "join").upper(), "MIT text"), (103, "Released under " + filler + " the MIT License", None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, want string"))
    found = {r.doc_id: [x.license for x in r.licenses] for r in got.collect()}
    for i, _, want in rows:
        assert found[i] == ([want] if want else []), i
    spans = {r.doc_id: r.licenses for r in got.collect()}
    words = scan_words(pa.array([rows[0][1]]))[0]
    x = spans[0][0]
    assert words[x.start : x.end].tolist() == scan_words(pa.array([TEMPLATES["Apache-2.0"]]))[0].tolist()
    assert license_scan(awkward(spark)).count() == len(AWKWARD) and license_scan(empty(spark)).count() == 0
