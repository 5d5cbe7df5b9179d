"""Periodic runs against a search at every period, and the query's digests."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np

from cachelake.llm.periodic_runs import kept_words, maximal_pairs, periodic_documents, periodic_runs, runs_of, suffix_order
from cachelake.llm.queries import QUERIES
from tests.llm.cases import AWKWARD, SCHEMA, awkward, empty


def plain_runs(words, least_words=24, least_periods=3):
    """Every period in turn; of equal stretches the smallest period's."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    letters, out = rng.choice([1, 2, 3, 8]), []
    for _ in range(rng.randrange(6)):
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return out


def test_runs_equal_a_search_at_every_period():
    rng = random.Random(3)
    for _ in range(600):
        rows = [texts(rng) for _ in range(rng.randrange(1, 5))]
        numbers = np.array([10 * k + w for k, r in enumerate(rows) for w in r], np.int64)
        least_words, least_periods = rng.choice([(24, 3), (6, 3), (10, 4), (3, 3)])
        got = runs_of(numbers, np.append(0, np.cumsum([len(r) for r in rows])), least_words, least_periods)
        assert got == [plain_runs(r, least_words, least_periods) for r in rows]


def test_suffixes_and_pairs_equal_their_definitions():
    rng = random.Random(4)
    for _ in range(200):
        w = texts(rng)
        n = len(w)
        if n < 2:
            continue
        order, common, _ = suffix_order(np.array(w, np.int64), 2)
        order = order.tolist()
        assert [w[i:] for i in order] == sorted(w[i:] for i in range(n))

        def shared(i, j):
            k = 0
            while max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            return k

        assert common[1:n].tolist() == [c if (c := shared(a, b)) >= 2 else 0 for a, b in zip(order, order[1:], strict=False)]
        before = np.append(-1, w[:-1])
        got = set(maximal_pairs(order, common[:n].tolist(), before))
        all_pairs = {(i, j, k) for i in range(n) for j in range(i + 1, n) if (k := shared(i, j)) >= max(2, 2 * (j - i)) and before[i] != before[j]}
        assert got <= all_pairs  # and of each stretch the smallest distance
        least = {}
        for i, j, k in all_pairs:
            least[i, j + k] = min(j - i, least.get((i, j + k), n))
        assert {(i, e - i - q) for (i, e), q in least.items()} <= {(i, k) for i, _, k in got}


def test_long_texts_take_no_square():
    for w in (np.zeros(100_000), np.tile(np.append(np.zeros(30), 1), 4000), np.concatenate([np.append(np.zeros(30), i + 1) for i in range(4000)])):
        began = time.time()
        runs = runs_of(w.astype(np.int64), np.array([0, len(w)]))[0]
        assert runs and time.time() - began < 20


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op12_periodic_runs"](spark, sf_dir))
    # The longest texts take the plain version a square; they are in the other tests.
    short = {d for d, t in docs if len((t or "").split()) < 1500}
    assert [r for r in got if r[0] in short] == sorted((plain_row(d, t) for d, t in docs if d in short), key=str)
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) > len(docs) / 20


def test_awkward_documents(spark):
    more = [(20 + i, t, "en", "a", 1) for i, t in enumerate(["a b c " * 8, "a b c " * 7 + "a b", "x " + "A a " * 12 + "y", "q " * 24, "q " * 23, "u v w x y z " * 9, "　a b " * 12, "n o p\tq\n" * 200])]
    rows = [r for r in AWKWARD if r[0] != 11] + more
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' runs", "'own' collapsed", "1 n_words", "'own' _text")
    assert rows_of(periodic_documents(df)) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert periodic_documents(awkward(spark)).count() == len(AWKWARD)
    for table in (awkward(spark), df, empty(spark)):
        out = periodic_runs(table)
        assert out.columns[: len(table.columns)] == table.columns and len(set(out.columns)) == len(table.columns) + 3
        assert out.select(table.columns).exceptAll(table).count() == 0 and out.count() == table.count()


def test_what_a_run_repeats_is_dropped():
    assert kept_words(10, [(1, 6, 2)]).tolist() == [True] * 3 + [False] * 4 + [True] * 3
    assert kept_words(0, []).tolist() == []
