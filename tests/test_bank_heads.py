"""Walks over generations and restores from a listing, in small cases."""

from datetime import datetime

from pyspark.sql import functions as F

from cachelake.plans import heads as hd

LISTING = "id long, name string, expired boolean, created_at timestamp_ntz, head_branch string, same_repo boolean"
SEGMENTS = "array<struct<name:string,bytes:bigint,blobs:bigint,prefixes:string,artifact:string,run:bigint,role:string,`full`:boolean>>"
MANIFESTS = f"artifact_id long, lineage string, generation long, parent_lineage string, parent_generation long, segments {SEGMENTS}"


def at(day):
    return datetime(2026, 7, day)


def listing(spark, rows):
    return spark.createDataFrame([(i, name, expired, at(day), branch, same) for i, name, day, branch, expired, same in rows], LISTING)


def art(i, lineage, part, day, expired=False, same=True, branch=None):
    return (i, f"cas-manifest-{lineage}-{part}", day, branch or lineage, expired, same)


def manifests(spark, rows):
    return spark.createDataFrame([(i, lin, gen, pl, pg, [(n, b, 1, p, c, run, role, False) for n, b, p, c, run, role in segs]) for i, lin, gen, pl, pg, segs in rows], MANIFESTS)


def walk(spark, artifacts, rows, lineage, parent=None):
    chain, ends = hd.manifest_chain(listing(spark, artifacts), manifests(spark, rows), lineage, parent)
    got = sorted((r.part, r.hop, r.lineage, r.generation, r.artifact_id) for r in chain.collect())
    return got, sorted((r.start, r.part, r.lineage, r.generation, r.parent_lineage, r.parent_generation, r.reason) for r in ends.collect())


def test_two_lineages_three_generations_and_a_gone_parent(spark):
    artifacts = [art(1, "dev", "r0", 9), art(2, "main", "r0", 5), art(3, "main", "r0", 4), art(4, "main", "r0", 3, expired=True), art(5, "dev", "r1", 9)]
    rows = [(1, "dev", 7, "main", 30, []), (2, "main", 30, "main", 29, []), (3, "main", 29, "main", 28, []), (4, "main", 28, None, None, []), (5, "dev", 7, "", 0, [])]
    got, ends = walk(spark, artifacts, rows, "dev")
    assert got == [("r0", 0, "dev", 7, 1), ("r0", 1, "main", 30, 2), ("r0", 2, "main", 29, 3), ("r1", 0, "dev", 7, 5)]
    assert ends == [("own", "r0", "main", 29, "main", 28, "gone"), ("own", "r1", "dev", 7, None, None, "root")]
    # The parent's head by name joins the same walk at its least distance.
    got, ends = walk(spark, [*artifacts, art(6, "main", "r1", 2)], [*rows, (6, "main", 1, None, None, [])], "dev", "main")
    assert [g[:4] for g in got if g[0] == "r0"] == [("r0", 0, "dev", 7), ("r0", 1, "main", 30), ("r0", 2, "main", 29)]
    assert ("r1", 1, "main", 1, 6) in got and ("parent", "r1", "main", 1, None, None, "root") in ends


def test_cycles_end_and_lookalikes_are_not_trusted(spark):
    artifacts = [art(1, "a", "r0", 3), art(2, "b", "r0", 2), art(3, "a", "r0", 1), art(9, "a", "r0", 8, same=False), art(8, "a", "r0", 8, branch="b"), art(10, "a-x", "r0", 9)]
    rows = [(1, "a", 1, "b", 1, []), (2, "b", 1, "a", 1, []), (3, "a", 1, None, None, []), (9, "a", 5, None, None, []), (8, "a", 6, None, None, []), (10, "a-x", 9, None, None, [])]
    got, ends = walk(spark, artifacts, rows, "a")
    assert got == [("r0", 0, "a", 1, 1), ("r0", 1, "b", 1, 2)] and ends == [("own", "r0", "b", 1, "a", 1, "cycle")]
    # The newest artifact counts even if it has no manifest; nothing is taken in its stead.
    assert walk(spark, [*artifacts, art(11, "a", "r0", 9)], rows, "a") == ([], [])
    assert walk(spark, artifacts, [], "a", "b") == ([], []) and walk(spark, artifacts, rows, "none") == ([], [])


def blob_bank(spark, **more):
    box = [(100 + i, f"box-{i}", 1, None, False, False) for i in (1, 2)]
    artifacts = [art(1, "dev", "r0", 9), art(2, "main", "r0", 5), art(3, "main", "r3", 5), *box, (50, "cas-spill-dev-x", 10, "dev", False, True), (51, "cas-spill-dev-y", 8, "dev", False, True)]
    rows = [
        (1, "dev", 2, "main", 4, [("s1", 10, "0f", "box-1", None, None), ("s2", 10, "f", "box-1", None, None), ("gone", 10, "1", "box-9", None, None)]),
        (2, "main", 4, None, None, [("s1", 10, "0f", "box-1", None, None), ("s3", 10, "1", "box-2", None, None), ("s4", 10, "0", None, None, None)]), (3, "main", 1, None, None, [("s9", 1, "0", "box-1", None, None)]),
    ]
    ids = spark.createDataFrame([(1, "0a"), (2, "0a"), (2, "1b"), (3, "7c"), (50, "no")], "artifact_id long, id string")
    payload = spark.createDataFrame([("s1", "0a", 5), ("s1", "f0", 6), ("s2", "f1", 1), ("s3", "1b", 7), ("s4", "0e", 1), ("s9", "0d", 1), ("gone", "1c", 1)], "segment string, hash string, bytes long")
    spills = spark.createDataFrame([(50, "1d", 3), (50, "9d", 3), (51, "1e", 3), (50, "1b", 99)], "spill long, hash string, bytes long")
    return hd.restore_blob_bank(listing(spark, artifacts), manifests(spark, rows), ids, payload, "dev", **{"parent": "main", "shard": 0, "spill_rows": spills} | more)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_blobs_from_a_listing(spark):
    got = blob_bank(spark)
    assert rows_of(got["blobs"], "hash", "bytes") == [("0a", 5), ("1b", 7), ("1d", 3), ("f0", 6)]
    assert rows_of(got["ids"], "id") == [("0a",), ("1b",), ("7c",)]  # of all ranges
    assert rows_of(got["missing"], "segment") == [("gone",)]
    assert rows_of(got["status"], "manifests", "inherited", "status", "own_state", F.dayofmonth("oldest_container")) == [(3, 2, "warm", "found", 1)]


def test_an_own_head_that_is_not_known_is_not_absent(spark):
    got = blob_bank(spark, own_known=False)
    assert rows_of(got["status"], "manifests", "status", "own_state") == [(2, "warm", "unknown")]
    assert rows_of(got["blobs"], "hash") == [("0a",), ("1b",), ("1d",), ("f0",)]
    got = blob_bank(spark, shard=5, parent=None)
    assert rows_of(got["status"], "own_state") == [("absent",)] and got["blobs"].where("bytes <> 3").count() == 0
    got = blob_bank(spark, shard=None)
    assert got["blobs"].count() == 0 and got["ids"].count() == 3


def test_rows_from_a_listing(spark):
    box = [(100 + i, f"box-{i}", 1, None, False, False) for i in (1, 2)]
    artifacts = [art(1, "dev", "ac-w1", 9), art(2, "dev", "ac-driver", 9), art(3, "main", "ac-w1", 9), *box]
    rows = [
        (1, "dev", 1, "main", 1, [("d1", 1, "", "box-1", 5, None), ("old", 1, "", "box-1", 9, "driver")]), (2, "dev", 1, None, None, [("d2", 1, "", "box-1", 5, None), ("lost", 1, "", "box-7", 99, None)]),
        (3, "main", 1, None, None, [("m1", 1, "", "box-2", 1000, None), ("old", 1, "", "box-1", 9, "driver")]),
    ]
    payload = spark.createDataFrame([("m1", "a", "x", 0), ("d1", "a", "y", 0), ("d1", "b", "p", 0), ("d2", "b", "q", 0), ("old", "b", "r", 0), ("lost", "b", "s", 0), ("m1", "c", "f", 1), ("m1", "d", "z", 0)], "segment string, path string, content_hash string, exit_code int")
    lists = spark.createDataFrame([(1, "a y"), (3, "a x")], "artifact_id long, id string")
    got = hd.restore_row_bank(listing(spark, artifacts), manifests(spark, rows), lists, payload, "dev", "main")
    assert rows_of(got["rows"], "path", "content_hash") == [("a", "y"), ("b", "r"), ("d", "z")]
    assert rows_of(got["missing"], "segment") == [("lost",)] and rows_of(got["ids"], "id") == [("a x",), ("a y",)]
    only = hd.restore_row_bank(listing(spark, artifacts), manifests(spark, rows[1:2]), lists, payload, "dev", "main", role="driver")
    assert rows_of(only["rows"], "path", "content_hash") == [("b", "q")]


def test_key_values_are_all_or_nothing_and_only_heads_count(spark):
    import hashlib

    gate = hashlib.sha256(b"s").hexdigest()[:8]
    box = [(100, "box-1", 1, None, False, False)]
    own, parent = art(1, "dev", f"kv-{gate}", 9), art(2, "main", f"kv-{gate}", 9)
    rows = [(1, "dev", 1, "main", 1, [("k1", 1, "", "box-1", None, None)]), (2, "main", 1, None, None, [("k2", 1, "", "box-1", None, None), ("k3", 1, "", "box-1", None, None)])]
    existing = spark.createDataFrame([(1, 1, "old")], "key_hi long, key_lo long, value string")
    payload = spark.createDataFrame([("k1", 1, 1, "new"), ("k1", 1, 2, "k1"), ("k2", 1, 3, "k2"), ("k3", 1, 4, "k3")], "segment string, key_hi long, key_lo long, value string")

    def restored(artifacts, rows):
        got = hd.restore_kv_bank(existing, listing(spark, artifacts), manifests(spark, rows), payload, "dev", "s", "main")
        return sorted(r.value for r in got.collect())

    assert restored([own, parent, *box], rows) == ["k1", "old"]
    assert restored([parent, *box], rows) == ["k2", "k3", "old"]
    broken = [(2, "main", 1, None, None, [("k2", 1, "", "box-1", None, None), ("k3", 1, "", "box-2", None, None)])]
    assert restored([parent, *box], broken) == ["old"] and restored(box, rows) == ["old"]


def test_listings_give_what_segments_give_and_only_the_chains_are_read(spark):
    """Manifests off the chain would list without end; none of them is met."""
    artifacts = listing(spark, [art(1, "dev", "r0", 9), art(2, "dev", "r1", 9), (100, "box-1", 1, None, False, False)])
    pointers = spark.createDataFrame([(1, "dev", 1, None, None, 7), (2, "dev", 1, None, None, 7), (3, "old", 1, None, None, 8)], "artifact_id long, lineage string, generation long, parent_lineage string, parent_generation long, listing int")
    row = "name string, bytes long, blobs long, prefixes string, artifact string, run long, role string, `full` boolean"
    segments = spark.createDataFrame([(7, "s1", 10, 1, "0", "box-1", None, None, False), (7, "s2", 10, 1, "1", "box-9", None, None, False), (8, "s3", 10, 1, "0", "box-1", None, None, False)], f"listing int, {row}")
    whole = manifests(spark, [(1, "dev", 1, None, None, (both := [("s1", 10, "0", "box-1", None, None), ("s2", 10, "1", "box-9", None, None)])), (2, "dev", 1, None, None, both), (3, "old", 1, None, None, [("s3", 10, "0", "box-1", None, None)])])
    ids = spark.createDataFrame([], "artifact_id long, id string")
    payload = spark.createDataFrame([("s1", "0a", 5), ("s2", "1b", 5), ("s3", "0c", 5)], "segment string, hash string, bytes long")
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    a = hd.restore_blob_bank(artifacts, whole, ids, payload, "dev", None, 0)
    b = hd.restore_blob_bank(artifacts, pointers, ids, payload, "dev", None, 0, listings=segments)
    for name in ("blobs", "missing", "plan", "status"):
        assert sorted(map(str, a[name].collect())) == sorted(map(str, b[name].collect())), name
    assert [tuple(r) for r in b["blobs"].collect()] == [("0a", 5)]
    chain = spark.createDataFrame([(1, "r0", 0)], "artifact_id long, part string, hop int")
    listed = hd.listed_segments(chain, pointers, segments).mapInArrow(count, "part string, hop int, segment string, container string, bytes long, blobs long, prefixes string, run long, role string, `full` boolean")
    assert {r.segment for r in listed.collect()} == {"s1", "s2"} and met.value == 2
