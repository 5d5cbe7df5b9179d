"""Small literal cases and invariants of the core operators."""

import hashlib
import struct

from pyspark.sql import functions as F

from cachelake.functions import expressions as ex
from cachelake.operators import aggregates as agg
from cachelake.operators import filters as fl
from cachelake.operators import joins as jn
from cachelake.operators import sets as st
from cachelake.operators import windows as wn
from cachelake.plans import jobs as jb
from cachelake.sources import tables as tb
from cachelake.streaming import streams as sm


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segment_bitmap(spark):
    items = spark.createDataFrame([("1111aaaa", 100), ("2222bbbb", 200), ("99ffcccc", 300)], "id string, bytes long").withColumn("s", F.lit(0))
    assert agg.segment_meta(items, ["s"]).select("blobs", "bytes", "prefixes").first() == (3, 600, "129")


def test_bank_and_spill_are_disjoint_and_complete(spark):
    ids = spark.createDataFrame([("0aaa0001",), ("1bbb0002",), ("2ccc0003",), ("edee0004",)], "hash string")
    assert rows(st.split_range(ids, 0)) == [("0aaa0001", "bank"), ("1bbb0002", "bank"), ("2ccc0003", "spill"), ("edee0004", "spill")]
    assert {r[1] for r in rows(st.split_range(ids, 0, state_known=False))} == {"spill"}
    owned = [d for s in range(8) for d in ex.owned_digits(s)]
    assert sorted(owned) == sorted("0123456789abcdef")


def test_mutable_row_is_banked_again(spark):
    new = spark.createDataFrame([("ac/aaaa", "v2")], "path string, content_hash string")
    old = spark.createDataFrame([("ac/aaaa", "v1")], "path string, content_hash string")
    assert jn.delta_by_version(new, old).count() == 1 and jn.delta_by_version(old, old).count() == 0


def test_collapse_keeps_the_last(spark):
    v = spark.createDataFrame([("ac/aaa", "hash-old", 0), ("acn/bb/ccc", "hash-c", 1), ("ac/aaa", "hash-new", 2), (None, "x", 3)], "path string, hash string, seq int")
    assert rows(wn.collapse_versions(v, ["seq"])) == [("ac/aaa", "hash-new"), ("acn/bb/ccc", "hash-c")]


def test_parent_never_beats_child(spark):
    plan = spark.createDataFrame([("p", 0, 1002, "driver"), ("c", 1, 900, "Linux-w1"), ("d", 1, 900, "driver")], "segment string, rank int, run int, role string")
    data = spark.createDataFrame([("a", "parent", "p"), ("a", "child", "c"), ("b", "worker", "c"), ("b", "driver", "d")], "path string, content_hash string, segment string")
    assert rows(wn.apply_order(data, plan).select("path", "content_hash")) == [("a", "child"), ("b", "driver")]


def test_segments_to_fetch(spark):
    s = spark.createDataFrame([("a", "129"), ("b", "e"), ("c", "*")], "segment string, prefixes string")
    pick = lambda o: sorted(r[0] for r in jn.segments_to_fetch(s, o).collect())
    assert (pick("9"), pick("e"), pick("45"), pick("*")) == (["a"], ["b"], [], ["a", "b", "c"])


def test_compaction_thresholds(spark):
    mb = 1 << 20
    data = [("floor", 1 * mb, False), ("cold", 300 * mb, False), ("small", 260 * mb, False), ("small", 2000 * mb, True), ("delta", 600 * mb, False), ("delta", 2000 * mb, True)]
    data += [("packs", 10 * mb, True)] * 70 + [("many", 1, False)] * 65
    got = {r["lineage"]: (r["compact"], r["reason"]) for r in agg.needs_compaction(spark.createDataFrame(data, "lineage string, bytes long, `full` boolean")).collect()}
    assert got == {"floor": (False, None), "cold": (True, "cold-bank"), "small": (False, None), "delta": (True, "delta"), "packs": (False, None), "many": (True, "segments")}


def test_policy_dates_and_budget(spark):
    now = 1785369600  # 2026-07-30
    heads = spark.createDataFrame([(x, 1, False) for x in ("fresh", "stale", "bad", "slow")], "lineage string, bytes long, `full` boolean")
    evidence = spark.createDataFrame([("fresh", 1, "2026-07-01T00:00:00Z"), ("stale", 1, "2026-04-01T00:00:00Z"), ("bad", 1, "2026-04-01"), ("slow", 999, None)], "lineage string, delta_restore_secs long, oldest string")
    got = {r[0]: r[1] for r in agg.compaction_policy(heads, evidence, now).collect()}
    assert got == {"fresh": "none", "stale": "rewarm", "bad": "none", "slow": "restore"}


def test_kv_lines(spark):
    lines = ["3 -200 19 0BADF00D", f"1 {2**53 + 1} {-(2**63)} ", f"1 {2**63 - 1} 0 AA", "x 1 2 AA", "1 2 3 ABC", "1 2 3 zz", "1 2", "", "1 9223372036854775808 0 AA"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = tb.read_kv_export(df).select("shard", "key_hi", "key_lo", F.hex("value"))
    assert rows(got) == [(1, 2**53 + 1, -(2**63), ""), (1, 2**63 - 1, 0, "AA"), (3, -200, 19, "0BADF00D")]
    assert tb.rejected_kv_lines(df).count() == 6


def test_exit_codes_and_verification(spark):
    r = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2), ("d", None)], "p string, exit_code int")
    assert [x[0] for x in rows(fl.purge_failures(r).select("p"))] == ["b", "d"]
    good = hashlib.sha256(b"abc").hexdigest()
    b = spark.createDataFrame([(good, bytearray(b"abc")), ("00" * 32, bytearray(b"x"))], "name string, content binary")
    assert tuple(fl.verify_counts(b).first()) == (1, 1)


def test_missing_tree_interior_is_unservable(spark):
    kind = "array<struct<hash:string,size:bigint>>"
    results = spark.createDataFrame([("act",)], "action string").select("action", F.array().cast(kind).alias("files"), F.array(F.struct(F.lit("tree").alias("hash"), F.lit(5).cast("long").alias("size"))).alias("trees"), F.lit(None).cast("struct<hash:string,size:bigint>").alias("stdout"), F.lit(None).cast("struct<hash:string,size:bigint>").alias("stderr"))
    directory = F.struct(F.struct(F.lit("d").alias("hash"), F.lit(0).cast("long").alias("size")).alias("digest"), F.array(F.struct(F.lit("file").alias("hash"), F.lit(7).cast("long").alias("size"))).alias("files"))
    trees = spark.range(1).select(F.lit("tree").alias("tree"), directory.alias("root"), F.array().cast("array<struct<digest:struct<hash:string,size:bigint>,files:array<struct<hash:string,size:bigint>>>>").alias("children"))
    refs, failed = jn.expand_trees(jn.result_refs(results), trees)
    asked = spark.createDataFrame([("act",), ("other",)], "key string")
    held = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    verdict = lambda h: {r["key"]: r["verdict"] for r in jn.validated_lookup(asked, results.select("action"), refs, h, failed).collect()}
    assert verdict(held("tree")) == {"act": "UNSERVABLE", "other": "MISS"}
    assert verdict(held("tree", "file")) == {"act": "HIT", "other": "MISS"}


def test_empty_digest_is_never_missing(spark):
    asked = spark.createDataFrame([(ex.EMPTY_HASH, 0), ("aa", 1), ("aa", 1)], "hash string, size long")
    assert rows(jn.find_missing(asked, spark.createDataFrame([("bb", 1)], "hash string, size long"))) == [("aa", 1), ("aa", 1)]


def test_bloom_has_no_false_negatives(spark):
    names = [hashlib.sha256(struct.pack("<I", i)).hexdigest() for i in range(3000)]
    nbits = ex.bloom_bits(1000)
    bits = jn.bloom_build(spark.createDataFrame([(h,) for h in names[:1000]], "hash string"), nbits)
    got = {r["hash"]: r["maybe"] for r in jn.bloom_probe(spark.createDataFrame([(h,) for h in names], "hash string"), bits, nbits).collect()}
    assert all(got[h] for h in names[:1000]) and sum(got[h] for h in names[1000:]) < 0.05 * 2000


def test_tokens(spark):
    cases = {
        "-Cmetadata=abc": "-Cmetadata=__CKEY__",
        "@@x/__a__/0123456789abcdef/args": "@@__norm__/__a__/args",
        "out/p/__lib__/0123456789abcdef/liba-0123abcd.rlib": "__norm__/__lib__/liba-00000000.rlib",
        "--path-env=OUT=p/__l__/output_artifacts/x": "--path-env=OUT=__norm__/__l__/x",
        "--path-env=OUT": "--path-env=OUT",
        "--remap-path-prefix=p/__l__/x-0123abcd.y=z": "--remap-path-prefix=__norm__/__l__/x-0123abcd.y=__norm__/",
        "serde-1.0.210": "serde-1.0.210",
        "plain": "plain",
    }
    df = spark.createDataFrame(list(cases.items()), "token string, want string")
    assert [r[:] for r in df.select("token", "want", ex.normalize_token("token").alias("got")).where("want <> got").collect()] == []


def test_packing_rules(spark):
    items = spark.createDataFrame([("a1", 5), ("a2", 5), ("a3", 30), ("a4", 1), ("b1", 1)], "id string, size long")
    assert rows(wn.pack_greedy(items, 10).select("id", "segment_no")) == [("a1", 0), ("a2", 0), ("a3", 1), ("a4", 2), ("b1", 0)]
    grouped = items.withColumn("g", F.lit("x"))
    assert rows(wn.pack_until_full(grouped, 10, "g").select("id", "segment_no")) == [("a1", 0), ("a2", 0), ("a3", 1), ("a4", 2), ("b1", 2)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("hit", x) for x in (1, 2, 3, 4)], "verdict string, us long")
    assert agg.latency_summary(df).select("n", "p50", "max").first() == (4, 3, 4)


def test_scans_prune(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    plan = jn.find_missing(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey hash", "l_linenumber size"), part.where("p_size <= 45").selectExpr("p_partkey hash", "p_size size"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(p_size,45)" in text and "l_extendedprice" not in text


def test_prefixes_grow_with_the_ids(spark):
    items = spark.range(40).selectExpr("sha2(cast(id as string),256) id", "1L size")
    assert [wn.prefix_length_of(items, most) for most in (40, 39, 2)] == [1, 2, 3]
    packed = wn.pack_greedy(items, 3, 2)
    assert packed.count() == 40 and packed.where("prefix <> substr(id,1,2)").count() == 0
    assert packed.groupBy("prefix", "segment_no").count().agg(F.max("count")).first()[0] <= 3


def test_row_bank_packs_fully_unless_it_would_shed(spark):
    new = spark.createDataFrame([("ac/a", "v2", 10, 0), ("ac/b", "v1", 10, 0), ("ac/c", "v1", 10, 1)], "path string, content_hash string, bytes long, exit_code int")
    heads = spark.createDataFrame([("main", 1, False)] * 33, "lineage string, bytes long, full boolean")
    evidence = spark.createDataFrame([], "lineage string, delta_restore_secs long, oldest string")
    two = spark.createDataFrame([("ac/a", "v1"), ("ac/b", "v1")], "path string, content_hash string")
    out = jb.publish_rows(new, two, 7, "driver", 100, heads=heads, evidence=evidence, lineage="main")
    assert rows(out["segments"].groupBy("full").agg(F.sum("blobs"))) == [(True, 2)] and rows(out["ids"]) == [("ac/a", "v2"), ("ac/b", "v1")]
    three = two.union(spark.createDataFrame([("ac/d", "v1")], "path string, content_hash string"))
    out = jb.publish_rows(new, three, 7, "driver", 100, heads=heads, evidence=evidence, lineage="main")
    assert rows(out["segments"].groupBy("full").agg(F.sum("blobs"))) == [(False, 1)] and rows(out["ids"]) == [("ac/a", "v2"), ("ac/b", "v1"), ("ac/d", "v1")]
    few = jb.publish_rows(new, two, 7, "driver", 100, heads=heads.limit(32), evidence=evidence, lineage="main")
    assert rows(few["segments"].select("full", "blobs")) == [(False, 1)]


def test_kv_generation_is_written(spark, tmp_path):
    packed = spark.createDataFrame([("1 2", 5, "0", 0), ("1 3", 5, "0", 0), ("2 3", 7, "1", 0)], "id string, size long, prefix string, segment_no int")
    payload = jb.publish_generation(jb.kv_bank(packed), f"file://{tmp_path}/gen", "kv", 1)
    assert rows(spark.read.parquet(payload).select("id", "bytes")) == [("1 2", 5), ("1 3", 5), ("2 3", 7)]
    listed = spark.read.json(f"file://{tmp_path}/gen/manifest").selectExpr("lineage", "inline(segments)")
    assert rows(listed.select("lineage", "blobs", "bytes", "prefixes")) == [("kv", 1, 7, "*"), ("kv", 2, 10, "*")]


def test_quorum_latches_with_the_join_that_completes_it(spark):
    data = [("f", 1, 1, "a"), ("f", 2, 2, "a"), ("f", 3, 3, "b"), ("f", 4, 4, "a"), ("g", 1, 5, "a"), (None, 1, 6, "a"), (None, 1, 7, "b")]
    joins = spark.createDataFrame(data, "fleet string, ts int, event int, worker string")
    assert {r["event"] for r in sm.quorum_latch(joins, 2).where("formed").collect()} == {3, 4, 7}
    assert sm.quorum_latch(joins.limit(0), 2).count() == 0


def test_publish_rows_reads_its_rows_once(spark):
    from cachelake.plans import jobs as jb

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "path string, content_hash string, bytes long, exit_code int"
    rows = spark.createDataFrame([(f"p{i % 40}", f"h{i % 60}", 5, 0) for i in range(200)], schema).mapInArrow(count, schema)
    banked = spark.createDataFrame([("p1", "h1"), ("p2", "old")], "path string, content_hash string")
    out = jb.publish_rows(rows, banked, 7, "driver", 100)
    assert out["packed"].count() == 119 and out["ids"].count() == 40
    assert read.value == 200
