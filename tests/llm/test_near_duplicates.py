import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cachelake.llm.common as common
import cachelake.llm.similarity as similarity
from cachelake.llm.common import connected_components, hash_words, shingle_hashes
from cachelake.llm.ngram_join import keep_one, ngram_join
from cachelake.llm.repeated_runs import _windows, repeated_runs
from cachelake.llm.signature_tree import Forest, linked_pairs, overlap
from cachelake.llm.similarity import BandKeys, PrefixKeys, distinct_sets
from cachelake.llm.substring_dedup import near_passages, read_paragraphs, substring_dedup

from .cases import AWKWARD, awkward, components, empty, shingles, words


def mutants(seed, families=12, each=8):
    rng, out = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}w{rng.randrange(40 if f % 3 else 400)}" for _ in range(rng.choice([5, 12, 30, 90, 200]))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [f"z{rng.randrange(50)}"]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_join_equals_all_pairs(spark, k, num, den):
    texts = mutants(k)
    sets = [shingles(t, k) for t in texts]
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets, num, den), strict=True))}
    got = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), k, num, den)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) < len(texts)


@pytest.mark.parametrize(("seed", "part"), [(3, 512), (77, 3)])
def test_numbers_of_links_equal_all_pairs(spark, monkeypatch, seed, part):
    import cachelake.llm.similarity as similarity

    monkeypatch.setattr(similarity, "LINK_PART", part)
    texts = mutants(seed, families=5, each=14)
    texts += texts[:9] + texts[:4] + ["", None]
    sets = [shingles(t, 3) for t in texts]
    want = [sum(bool(a and b) and i != j and 10 * len(a & b) >= 7 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    classes = components(sets, 7, 10)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 3, 7, 10).collect()}
    assert got == {i: (c, n) for i, (c, n) in enumerate(zip(classes, want, strict=True))}
    # Classes of several texts, in which not all are linked with all.
    kinds = {}
    for c, s, n in zip(classes, sets, want, strict=True):
        kinds.setdefault(c, {})[s] = n
    assert any(len(k) >= 3 and len(set(k.values())) > 1 for k in kinds.values())


def test_overlaps_in_slices():
    import cachelake.llm.similarity as similarity

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 60, 200, 299)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for width in (7, 4096):
        got = similarity.overlaps(sets, width)
        assert (got - np.diag(np.diag(got))).tolist() == (np.array(want) - np.diag(np.diag(want))).tolist()
    assert similarity.overlaps([np.array([1], np.uint64), np.array([2], np.uint64)]).tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("hot", [False, True])
def test_large_groups_and_hot_keys_lose_no_links(spark, monkeypatch, hot):
    import cachelake.llm.similarity as similarity

    monkeypatch.setattr(similarity, "GROUP_PART", 8)
    if hot:
        monkeypatch.setattr(similarity, "HOT", 16)
    texts = mutants(77, families=2, each=60)
    sets = [shingles(t, 3) for t in texts]
    want = dict(enumerate(components(sets, 4, 5)))
    got = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 4, 5)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_awkward_rows(spark):
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in ngram_join(awkward(spark), 3, 4, 5).collect())
    by = {k[1]: (n, c) for k, n, c in got if not k[0]}
    assert len(got) == len(AWKWARD)
    assert by[1] == (58, 1) and by[2] == (58, 1) and by[3] == (58, 1)
    assert by[5] == (0, 5) and by[6] == (0, 6) and by[7] == (0, 7) and by[8] == by[9] == (1, 8)
    assert by[4] == (58, 4)
    assert [(n, c) for k, n, c in got if k[0]] == [(0, None), (59, 4)]
    assert ngram_join(empty(spark)).count() == 0
    kept = keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, i) for i in (1, 4, 5, 6, 7, 8, 10, 11)] + [(True, 0)]


def test_unrelated_texts_without_ids_or_with_one_id_all_stay(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    near = text["a"] + " tail"
    docs = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"]), (7, text["d"]), (7, text["e"]), (7, text["e"]), (8, text["f"]), (8, text["g"]), (9, text["g"]), (None, near)]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sum(t in (text["a"], near) for _, t in kept) == 1
    assert sorted((i or 0, t) for i, t in kept if t not in (text["a"], near)) == [(0, text["b"]), (0, text["c"]), (7, text["d"]), (7, text["e"]), (8, text["f"]), (8, text["g"])]


def test_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        for n in (3, 16, 17, 40, 150, 900):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = len(base) * (den - num) // den
            other = np.unique(np.concatenate([rng.permutation(base)[drop:]]))
            assert overlap(base, other) * den >= num * len(np.union1d(base, other))
            flat, offsets = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
            k, own, count = PrefixKeys(num, den)(flat, offsets, lambda x: (x >> np.uint64(60)).astype(np.uint8))
            assert len(k) == len(own) == len(count) and set(k[own == 0].tolist()) & set(k[own == 1].tolist())
    sets, at = distinct_sets(np.array([5, 3, 5, 1], np.uint64), np.array([0, 3, 3, 4]))
    assert sets.tolist() == [3, 5, 1] and at.tolist() == [0, 2, 2, 3]


def test_recall_of_the_bands():
    rng, keys = np.random.default_rng(6), BandKeys(9, 3, 4, 5)
    met = 0
    for _ in range(1500):
        base = rng.integers(0, 1 << 63, 66, dtype=np.uint64)
        flat = np.concatenate([base[:63], base[7:]])  # 56 of 66 in common
        table = keys.table(flat, np.array([0, 63, len(flat)]))
        met += bool((table[:, 0] == table[:, 1]).any())
    assert met >= 0.99 * 1500


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(2)
    pool = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (20, 50, 120)]
    sets = [np.unique(np.concatenate([rng.permutation(p)[rng.integers(0, 6) :], rng.integers(0, 1 << 62, rng.integers(0, 4), dtype=np.uint64)])) for p in pool for _ in range(40)]
    linked_pairs(sets, np.arange(len(sets)), None, 9, 10, forest := Forest(len(sets)))
    assert [forest.find(i) for i in range(len(sets))] == components([frozenset(s.tolist()) for s in sets], 9, 10)


def test_signatures_part_no_linked_sets():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 8, 63, 64, 65, 127, 128, 140, 700, 20_000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        more = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)
        sets += [base, np.unique(np.append(base, more)), base[n // 10 :], np.unique(np.append(base[n // 20 :], more[: n // 20]))]
        sets += [np.unique(np.append(base[:1], rng.integers(0, 1 << 63, n, dtype=np.uint64)))]
    flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    signs = similarity.signatures(flat, offsets)
    for num, den in ((9, 10), (4, 5), (1, 3)):
        got = similarity.able_classes([len(s) for s in sets], signs, num, den)
        want = components([frozenset(s.tolist()) for s in sets], num, den)
        assert len(set(want)) > 10 and all(got[i] == got[w] for i, w in enumerate(want))
    # Sets of one common token are told apart.
    assert len(set(similarity.able_classes([len(sets[k]) for k in range(4, 50, 5)], [signs[k] for k in range(4, 50, 5)], 9, 10).tolist())) == 10
    assert len({*similarity.able_classes([len(sets[k]) for k in (10, 14)], [signs[k] for k in (10, 14)], 4, 5).tolist()}) == 2


def test_texts_that_share_a_passage_by_chance_are_not_fetched(spark):
    def read(batch):
        words, rows = hash_words(batch.column(0))
        return similarity.Units(*distinct_sets(*shingle_hashes(words, rows, 3)), {"at": pa.nulls(batch.num_rows, pa.int64())})

    texts = [" ".join(f"w{k % 10} of {k % 10} t{k}x{i}" if i == 50 else f"t{k}x{i}" for i in range(100)) for k in range(60)]
    texts.append(texts[7] + " end")
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for keys in (PrefixKeys(9, 10), PrefixKeys(4, 5)):
        _, found, sets = similarity.find_links(docs, "text", read, "at long", keys)
        assert sets.count() == 2 and found.select("component").distinct().count() == 1 and found.count() == 2


def test_only_sets_that_signatures_allow_are_compared(monkeypatch):
    rng, compared = np.random.default_rng(8), []
    end = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    sets = [np.unique(np.append(end, rng.integers(0, 1 << 62, 12, dtype=np.uint64))) for _ in range(120)]
    sets += [s[:-1] for s in sets[::6]]
    monkeypatch.setattr(similarity, "overlap", lambda a, b: (compared.append(1), overlap(a, b))[1])
    found = BandKeys(9, 1, 4, 5).join(sets, np.arange(len(sets)), None, Forest(len(sets)))
    assert sorted(found) == [(6 * k, 120 + k) for k in range(20)]
    assert len(compared) < 100  # 9 bands of 1 let thousands of pairs meet


def test_anchors_are_spread_over_shards():
    text = pa.array([" ".join(f"w{i}" for i in range(20_000))])
    batch = pa.RecordBatch.from_arrays([text, pa.nulls(1, pa.list_(pa.int64()))], names=["text", "gone"])
    anchors = np.unique(_windows(batch, 50)[2])
    share = np.bincount((anchors >> np.uint64(61)).astype(np.int64), minlength=8) / len(anchors)
    assert share.min() > 0.08 and share.max() < 0.17


@pytest.mark.parametrize("part", [24, 14])
def test_bitmaps_are_made_in_tasks(spark, monkeypatch, part):
    monkeypatch.setattr(common, "LEAST_BITMAP", 27 if part == 24 else 18)
    monkeypatch.setattr(common, "PART_BITMAP", part)
    key = F.xxhash64("id").alias("key")
    few = common.stage(spark.range(0, 3000, 3).select(key, F.col("id").alias("own")), "few")
    rows = spark.range(4000).select("id", key)
    want = {i: i if i < 3000 and i % 3 == 0 else None for i in range(4000)}
    tracemalloc.start()
    joined, among = common.join_few(rows, few, "key"), common.may_be_among(rows, few, "key")
    # The driver's Python has no bitmap, and neither has the plan.
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert "LocalRelation" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.own for r in joined.collect()} == want
    found = {r.id for r in among.collect()}
    assert {i for i, own in want.items() if own is not None} <= found and len(found) < 1100
    masks, bits = common.bitmap(few, "key")
    keys = np.array([r.key for r in rows.orderBy("id").collect()]).view(np.uint64)
    assert set(np.flatnonzero(common.in_bitmap(masks.value, bits, keys)).tolist()) == found
    assert len(masks.value) == 1 << bits - part and not common.in_bitmap({}, bits, keys).any()


def test_no_keys_make_an_empty_bitmap(spark):
    rows = spark.range(5).select("id", F.xxhash64("id").alias("key"))
    none = common.stage(rows.where("id < 0").withColumnRenamed("id", "own"), "few")
    assert [(r.id, r.own) for r in common.join_few(rows, none, "key").orderBy("id").collect()] == [(i, None) for i in range(5)]
    assert not common.may_be_among(rows, none, "key").take(1) and common.bitmap(none, "key")[0].value == {}


def test_what_was_staged_on_the_way_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(k, f"a{k // 3} " + " ".join(f"w{k // 3}x{i}" for i in range(90)), 9) for k in range(30)], "doc_id long, text string, n_chars int")
    kept = keep_one(docs)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["near-copies"] and kept.count() == 10
    cut = substring_dedup(docs)
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["near-copies", "near-passages", "repeated-edits"]
    assert cut.where("size(passages) > 0").count() == 20


def test_shuffle_files_go_with_their_write(spark):
    before = spark.conf.get(common.CLEANUP, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = tracker.shuffleStatuses().size()
    staged = common.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    assert tracker.shuffleStatuses().size() <= known
    assert staged.count() == 7 and spark.conf.get(common.CLEANUP, None) == before


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(100, 5), (101, 5), (5, 101), (7, 7), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(10, 31), 10), 5: 5, 100: 5, 101: 5}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_repeated_passages_leave_all_but_one(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"intro one\n{passage}\nend"), (2, f"{passage}\nother text"), (3, "clean\n" + " ".join(f"c{i}" for i in range(70))), (4, f"a\n\n{passage}\n"), (4, f"a\n\n{passage}\n"), (5, None), (None, passage), (6, ""), (7, "a short text"), (8, "a short text"), (9, "a short text and more")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("at", F.lit(1)).withColumn("near", F.lit(2))
    got = sorted((r.doc_id or 0, r.text, r.n_chars, len(r.passages)) for r in substring_dedup(df).collect() if r.text is not None)
    assert got == sorted([(0, passage, len(passage), 0), (1, "intro one\nend", 13, 1), (2, "other text", 10, 1), (3, docs[2][1], len(docs[2][1]), 0), (4, "a\n", 2, 1), (4, "a\n", 2, 1), (6, "", 0, 0), (7, "a short text", 12, 0), (8, "", 0, 1), (9, "a short text and more", 21, 0)])
    out = substring_dedup(df)
    assert out.columns == [*df.columns, "passages"] and out.select("at", "near").distinct().collect() == [(1, 2)]
    assert substring_dedup(empty(spark)).count() == 0
    again = substring_dedup(awkward(spark))
    assert again.count() == len(AWKWARD) and set(awkward(spark).columns) <= set(again.columns)
    assert all(r[c] == "own" for r in again.collect() for c in ("rk", "fp", "score", "removed", "_key"))


def near_texts(seed):
    """Texts of which later ones hold long passages of earlier ones, a few words changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared = [[word() for _ in range(rng.randrange(240, 400))] for _ in range(4)]
    out = []
    for _ in range(16):
        passage = list(rng.choice(shared))
        for at in range(rng.randrange(20, 60), len(passage), 70):
            passage[at] = word()
        words = [word() for _ in range(rng.randrange(80))] + passage + [word() for _ in range(rng.randrange(80))]
        out.append("".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_near_passages_equal_all_pairs(spark, seed):
    texts = near_texts(seed)
    units = read_paragraphs(5, pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array(range(len(texts)))], names=["text", "doc_id", "rk"]))
    sets = [frozenset(units.tokens[a:b].tolist()) for a, b in zip(units.offsets[:-1], units.offsets[1:], strict=True)]
    ids, word, n, total = (units.columns[c].to_pylist() for c in ("doc_id", "word", "words", "total"))
    assert all(sum(b for a, b in zip(ids, n, strict=True) if a == i) == len(words(t)) for i, t in enumerate(texts))
    order, bounds = units.ordered
    known, want = {}, {}
    for i, f in enumerate(components(sets, 4, 5)):
        if ids[f] != ids[i]:
            x = order[bounds[i] : bounds[i + 1]].tolist()
            at = [k for k, t in enumerate(x) if t in sets[f]]
            a, b = (at[0], at[-1] + 5) if at and sets[i] != sets[f] and sets[i] not in known else (0, n[i])
            spans = want.setdefault(ids[i], [])
            if spans and sum(spans[-1]) + 10 >= word[i] + a:
                spans[-1][1] = word[i] + b - spans[-1][0]
            else:
                spans.append([word[i] + a, b - a])
        known[sets[i]] = i
    want = {i: kept for i, spans in want.items() if (kept := [s for s in spans if s[1] >= 50 or s[1] == total[ids.index(i)]])}
    got = substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    exact = {r.doc_id: [[p.word, p.words] for p in r.passages] for r in got if r.passages}
    source = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rk long").repartition(3)
    near = {r.rk: [[p.word, p.words] for p in r.passages] for r in near_passages(source, 50, 5, BandKeys(9, 3, 4, 5)).collect()}
    assert near == want and len(near) > 1
    assert all(s in exact[i] for i, spans in near.items() for s in spans)


def test_no_run_is_left_in_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in substring_dedup(docs).collect()}
    repeats, seen, clean = Counter(), set(), Counter(w for t in before.values() for w in {tuple(x) for x in windows(t, 50)})
    for i in sorted(after):
        own = {tuple(x) for x in windows(after[i].text, 50)}
        repeats[i] = len(own & seen)
        seen |= own
    assert len(after) == len(before) and not sum(repeats.values())
    # A text none of whose runs of 20 words occurs elsewhere is left alone, as is one no earlier text shares anything with.
    short = Counter(w for t in before.values() for w in {tuple(x) for x in windows(t, 20)})
    alone = [i for i, t in before.items() if len(words(t)) >= 20 and all(short[tuple(x)] == 1 for x in windows(t, 20))]
    assert len(alone) > 300 and all(after[i].text == before[i] and after[i].n_chars == len(before[i]) for i in alone)
    copies = [i for i, t in before.items() if t and any(j < i and before[j] == t for j in before)]
    assert copies and all(not words(after[i].text) for i in copies) and clean


def windows(text, m):
    w = words(text)
    return [w[i : i + m] for i in range(len(w) - m + 1)]


def test_passages_inside_longer_lines_and_over_line_ends(spark):
    own = {k: [f"{k}{i}" for i in range(90)] for k in "abcdefgh"}
    passage = [f"p{i}" for i in range(52)]
    wrapped = " ".join(passage[:20]) + "\n" + " ".join(passage[20:41]) + "\n" + " ".join(passage[41:])
    short = " ".join(passage[:49])
    line = " ".join(f"l{i}" for i in range(60))
    docs = [
        (1, " ".join(own["a"][:20] + passage + own["a"][20:40])), (2, " ".join(own["b"] + passage)), (3, f"head\n{wrapped}\nfoot"),
        (4, " ".join(own["c"][:5]) + f" {wrapped} " + " ".join(own["c"][5:9])), (5, " ".join(own["d"]) + f" {short} tail"),
        (6, f"{line}\n{' '.join(own['e'])} ä {line} ö"), (7, f"x\n{line}\n{wrapped}\ny"), (8, "long " * 120 + "end"),
    ]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got[1].text == docs[0][1] and got[5].text == docs[4][1]
    assert got[2].text == " ".join(own["b"]) and [tuple(p) for p in got[2].passages] == [(90, 52, 1)]
    assert got[3].text == "head\nfoot" and got[4].text == " ".join(own["c"][:9])
    assert got[6].text == docs[5][1] and got[7].text == "x\ny"
    assert got[8].text == docs[7][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_all_windows(spark, seed):
    rng, m = random.Random(seed), 50
    pool = [[f"s{k}_{i}" for i in range(rng.randrange(45, 120))] for k in range(6)]
    docs = []
    for d in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(max(1, len(p) - 50))
            words += [f"d{d}_{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] + p[a : a + rng.randrange(40, 120)]
        docs.append((d, words))
    first, want = {}, {}
    for d, words in docs:
        lost = set()
        for i in range(len(words) - m + 1):
            where = first.setdefault(tuple(words[i : i + m]), (d, i))
            if where[0] != d:
                lost.update(range(i, i + m))
        want[d] = [w for i, w in enumerate(words) if i not in lost]
    rows = [(d, "".join(w + (rng.choice("\n ") if i % 7 == 6 else " ") if i % 40 != 39 else w + "\n" for i, w in enumerate(words))) for d, words in docs]
    source = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, rk long").selectExpr("*", "cast(null as array<struct<word: long, words: long>>) gone")
    spans = {r.rk: r.passages for r in repeated_runs(source.repartition(5), m).collect()}
    got = {d: [w for i, w in enumerate(words) if not any(p.word <= i < p.word + p.words for p in spans.get(d, ()))] for d, words in docs}
    assert got == want and sum(map(len, want.values())) < sum(len(w) for _, w in docs)
