import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cachelake.llm.mixing import MIX_SQL, mix_sources
from cachelake.llm.packing import WordIds, default_vocabulary, nnls, pack_documents, plan

from .cases import AWKWARD, awkward, empty


def test_mixing_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "copy")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select doc_id, source, copy from ({MIX_SQL})").fetchall())


def test_rates_follow_weights(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id < 5000, 'big', 'small') source", "'t' text")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    n = {r[0]: r[1] for r in mix_sources(docs, weights).groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 3000) < 250
    one = mix_sources(docs.where("source = 'small'"), weights, epochs=700.0).groupBy("doc_id").count().agg({"count": "variance"}).first()[0]
    assert abs(one - 700) < 120  # a Poisson count's variance is its mean
    far = mix_sources(docs.where("source = 'small'"), weights, epochs=700.0).groupBy("doc_id").count().agg({"count": "avg"}).first()[0]
    assert abs(far - 700) < 10
    assert mix_sources(empty(spark)).count() == 0
    some = mix_sources(awkward(spark), epochs=20.0)
    assert some.count() > len(AWKWARD) and set(awkward(spark).columns) <= set(some.columns)
    assert some.where("source is null").count() > 0
    clash = awkward(spark).selectExpr("*", "1 rate", "2 origin", "3 times", "4 nth", "5 _rate", "6 order", "7 own", "8 words")
    out = mix_sources(clash, epochs=20.0)
    assert out.select("rate", "origin", "times", "nth", "_rate", "rk").distinct().collect() == [(1, 2, 3, 4, 5, "own")]


def test_large_rates_equal_sql(spark):
    # A tiny source beside a large one: its rate is beyond one draw's reach.
    con = duckdb.connect()
    con.execute("create table documents as select range::bigint doc_id, 't' as text, 'en' lang, if(range < 600000, 'big', 'one') source, 1 n_chars from range(600001)")
    want = con.execute(f"select doc_id, max(copy), count(*) from ({MIX_SQL}) where source = 'one' group by doc_id").fetchall()
    docs = spark.range(600001).selectExpr("id doc_id", "'t' text", "'en' lang", "if(id < 600000, 'big', 'one') source", "1 n_chars")
    got = mix_sources(docs).where("source = 'one'").groupBy("doc_id").agg(F.max("copy"), F.count("*")).collect()
    assert [tuple(r) for r in got] == want and want[0][2] > 600


def test_stages_take_awkward_tables(spark, sf_dir, tmp_path, monkeypatch):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() > 0) == (name == "awkward")
        for _, stage in corpus_pipeline.STAGES[:4]:
            after = stage(spark, docs, f"{tmp_path}/{name}")
            assert after.columns == docs.columns
            kept = {tuple(r) for r in after.select("rk", "fp", "score", "removed", "copy", "weight", "_key", "component_id").distinct().collect()} if name == "awkward" else set()
            assert kept <= {("own",) * 8}


def best_fit_decreasing(h, most):
    gaps, n = np.zeros(most + 1, int), 0
    for size in range(most, 0, -1):
        for _ in range(int(h[size])):
            at = np.flatnonzero(gaps[size:])
            room = int(at[0]) + size if len(at) else most
            if len(at):
                gaps[room] -= 1
            else:
                n += 1
            if room > size:
                gaps[room - size] += 1
    return n


def test_plan_holds_all_documents():
    rng = np.random.default_rng(0)
    for most, lengths in ((4096, rng.lognormal(6.3, 1.2, 20_000)), (4096, np.full(500, 2000)), (4096, np.array([4096, 1, 1])), (512, rng.integers(1, 513, 3000)), (4096, np.zeros(0))):
        h = np.bincount(np.clip(lengths.astype(int), 1, most), minlength=most + 1) if len(lengths) else np.zeros(most + 1, int)
        groups = plan(h, most)
        back = np.zeros(most + 1, int)
        for times, parts, gap in groups:
            assert times > 0 and sum(parts) + gap == most and gap >= 0
            np.add.at(back, parts, times)
        assert (back == h).all()
        assert sum(g[0] for g in groups) <= 1.003 * best_fit_decreasing(h, most) + 1
    assert np.allclose(nnls(np.eye(3), np.array([1.0, -2.0, 3.0])), [1, 0, 3])


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    got = pack_documents(awkward(spark).repartition(3), most=512).collect()
    want = []
    for i, t, *_ in AWKWARD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, at, len(x), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(ids), 512)) for x in [ids[at : at + 512]]]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 512
    assert pack_documents(empty(spark)).count() == 0


def test_words_are_tokenized_as_in_texts(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts.append("It's  \"quoted,\" don't; Wow!!! a..b,c. ÉCOLE, naïve! x². İstanbul. ΣΑΣ. &&&, foo<|endoftext|>bar 12,345.67 ́, \x1cfoo\x1d")
    ids = WordIds(default_vocabulary())
    split = [t.encode().split() for t in texts]
    ids.learn(set().union(*split))
    for words, e in zip(split, ids.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert b"".join(map(ids.__getitem__, words)) == np.array(e.ids, "<u4").tobytes()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, before, sf_dir)
        sizes.append(out.count())
        if k < 4:
            assert out.columns == docs.columns
        if k in (0, 1):
            assert out.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[2] <= sizes[1] <= sizes[0] and sizes[3] == sizes[2] and sizes[5] >= sizes[4]
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
