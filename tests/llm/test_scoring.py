import math
import random
import zlib
from collections import Counter

import numpy as np

import cachelake.llm.language_model as language_model
from cachelake.llm import quality as quality_parts
from cachelake.llm.language_model import EliasFano, pack, score_documents, unpack
from cachelake.llm.quality import quality
from cachelake.llm.toxicity import drop_toxic, toxicity

from .cases import AWKWARD, awkward, empty, words


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for universe, n in ((1 << 64, 5000), (1 << 41, 3000), (10, 400), (1 << 20, 1)):
        x = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = EliasFano(memoryview(EliasFano.build(x, universe)))
        assert (e.get(np.arange(n)) == x).all()
        probe = np.concatenate([x[::7], rng.integers(0, universe, 200, dtype=np.uint64)])
        got = e.successor(probe, np.zeros(len(probe), int), np.full(len(probe), n))
        assert (got == np.searchsorted(x, probe)).all()
    arrays = [np.arange(5, dtype=np.uint8), np.zeros(0, np.int64), np.array([1.5, -2.0]), np.arange(3, dtype=np.uint64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_close_values_are_read_in_order(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(0, 1 << 50, 20_000, dtype=np.uint64))
    e, read = EliasFano(memoryview(EliasFano.build(x, 1 << 50))), []
    with_low = e._with_low
    monkeypatch.setattr(e, "_with_low", lambda high, i: (read.append(len(i)), with_low(high, i))[1])
    lo = np.arange(0, 20_000, 2) // 100 * 100
    assert (e.successor(x[::2], lo, lo + 100) == np.arange(0, 20_000, 2)).all() and (e.get(np.arange(9000, 1000, -1)) == x[9000:1000:-1]).all()
    assert sum(read) < 2 * len(x)  # halving each one's range reads 7 values of it
    for k in (1, 5, 4000):
        probe, lo = rng.integers(0, 1 << 50, k, dtype=np.uint64), rng.integers(0, 20_001, k)
        hi = np.minimum(lo + rng.integers(0, 300, k), 20_000)
        want = [a + np.searchsorted(x[a:b], p) for p, a, b in zip(probe, lo, hi, strict=True)]
        assert e.successor(probe, lo, hi).tolist() == want


def test_each_pair_is_searched_once(monkeypatch):
    monkeypatch.setattr(language_model, "SEARCHED", 7)
    rng, asked = np.random.default_rng(3), []
    context, successor = (rng.integers(0, n, 400).astype(np.uint64) for n in (9, 5))

    class Counting:
        def score(self, c, s):
            asked.extend(zip(c.tolist(), s.tolist(), strict=True))
            return c * 10.0 + s, s > 2

    order, start, times = language_model._runs(context, successor)
    value, seen = language_model.search_once(Counting(), context[order][start], successor[order][start], order, times)
    assert value.tolist() == (context * 10.0 + successor).tolist() and seen.tolist() == (successor > 2).tolist()
    assert sorted(asked) == sorted(set(zip(context.tolist(), successor.tolist(), strict=True)))
    none = np.zeros(0, np.int64)
    assert [len(x) for x in language_model.search_once(Counting(), none, none, none, none)] == [0, 0]


def plain_scores(rows):
    seqs = [words(t) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c, pair, ctx = Counter(), Counter(), Counter()
    for s, h in zip(seqs, held, strict=True):
        if not h:
            c.update(s)
            for a, b in zip(["^", *s[:-1]], s, strict=True):
                pair[a, b] += 1
                ctx[a] += 1
    types = Counter(a for a, _ in pair)
    n, v = sum(c.values()), len(c)
    out = []
    for s, h in zip(seqs, held, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s)
        score = 0.0
        for a, b in zip(["^", *s[:-1]], s, strict=True):
            back = types[a] / (ctx[a] + types[a]) if ctx[a] else 1.0
            p = (c[b] + 1) / (n + v + 1)
            score += math.log10(pair[a, b] / (ctx[a] + types[a]) + back * p if pair[a, b] else back * p)
        out.append((h, len(s), sum(c[w] > 0 for w in s), n, base, score))
    return out


def test_scores_equal_a_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in score_documents(docs).collect()}
    total = [0.0, 0.0]
    for (i, _), (h, n, k, t, base, score) in zip(rows, plain_scores(rows), strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, t) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - score) < 0.01 * n + 0.1, (i, n, r.score - score)  # 8-bit codes
        if h:
            total = [total[0] + r.score, total[1] + r.base_score]
    assert total[0] > total[1]


def test_awkward_rows(spark):
    rows = [(a, t) for a, t, *_ in AWKWARD]
    want = sorted((str(i), w[:4], round(w[4], 6)) for (i, _), w in zip(rows, plain_scores(rows), strict=True))
    got = sorted((str(r.doc_id), (r.held_out, r.n_tokens, r.n_known, r.train_tokens), round(r.base_score, 6)) for r in score_documents(awkward(spark).repartition(3)).collect())
    assert got == want
    assert score_documents(empty(spark)).count() == 0


def test_toxicity_is_learned(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hits = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert sum(hits) >= 0.7 * len(hits) and sum(false) <= 0.01 * len(false)
    assert all(0 <= r.score <= 1 for r in got)


def test_classifiers_take_awkward_rows(spark, sf_dir):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (4, None, 0), (None, 1, 1), (4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity, quality):
        assert f(awkward(spark), labels).count() == len(AWKWARD)
        assert f(empty(spark), labels).count() == 0
        none = f(awkward(spark), labels.where("false")).select("score").distinct().collect()
        assert [r[0] for r in none] == [0.0 if f is toxicity else 0.5]
    kept = drop_toxic(awkward(spark), labels.where("false"))
    assert kept.columns == awkward(spark).columns and kept.count() == len(AWKWARD)


def test_quality_is_learned(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    low = [r.predicted for r in got if r.quality == 0]
    high = [r.predicted for r in got if r.quality == 1]
    assert sum(high) >= 0.97 * len(high) and sum(low) <= 0.15 * len(low)


def two_views(spark, n=3000, told=300, seed=6):
    """Pages whose words and sources both tell their quality, in part."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        own = rng.randrange(400) if rng.random() < 0.8 else None
        text = " ".join(f"{'g' if (good if own is not None and rng.random() < 0.6 else rng.random() < 0.5) else 'b'}{rng.randrange(400)}" for _ in range(6))
        source = f"{'good' if (good if rng.random() < 0.9 else not good) else 'bad'}{rng.randrange(60)}"
        docs.append((i, text, "en", source, len(text)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), labels, spark.createDataFrame(labels[:told], "doc_id long, quality int")


def test_views_teach_each_other(spark):
    docs, truth, labels = two_views(spark)
    right = []
    for rounds in (0, 3):
        got = {r.doc_id: r.predicted for r in quality(docs, labels, rounds=rounds, share=0.3, precision=0.8).collect()}
        right.append(sum(got[i] == y for i, y in truth[300:]))
    assert right[1] >= right[0] > 0.7 * 2700


def test_learners_do_not_depend_on_partitions(spark):
    docs, _, labels = two_views(spark, 600)
    rows = quality_parts.feature_rows(docs, labels, "quality", 8192, "false", 12)
    state = quality_parts._fit_labelled(quality_parts._sample(rows, 8192), 12)[:2]
    weights, rest = quality_parts._weights(state, 12), quality_parts.stage(rows.where("label is null"), "test-rest")
    counts = quality_parts.margin_counts(rest, weights)
    assert counts.sum(1).tolist() == [300, 300]
    cuts = [(quality_parts.BINS // 2 - 1, quality_parts.BINS // 2)] * 2
    a, b = (quality_parts.teach(rest.repartition(k), state, weights, cuts, 600, 12) for k in (1, 5))
    assert np.array_equal(a, b) and not np.array_equal(a, state)


def test_cuts_keep_to_the_share_and_to_what_is_sure():
    margin, labels = np.array([-9.0, -8, -7, -1, 1, 2, 3, 9] * 5), np.array([0, 0, 0, 1, 0, 1, 1, 1] * 5)
    low, high = quality_parts.sure_from(margin, labels, 0.9)
    assert quality_parts.bin_of(np.array([-7.0, 2.0])).tolist() == [low, high]
    assert quality_parts.sure_from(margin[:2], labels[:2], 0.9) == (-1, quality_parts.BINS)
    counts = np.zeros((2, quality_parts.BINS), np.int64)
    counts[:, [100, 200, 3000, 4000]] = 25
    assert quality_parts.cuts_of(counts, [(2000, 2100), (150, 5000)], 0.5, 0.5) == [(100, 4000), (100, 5000)]
    assert quality_parts.cuts_of(counts, [(2000, 2100)] * 2, 1.0, 0.9) == [(100, 2100)] * 2
