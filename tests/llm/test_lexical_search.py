"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cachelake.llm import lexical_search
from cachelake.llm.lexical_search import Block, count_terms, document_frequencies, levels_of, read_items, search, signature_blocks, weigh
from cachelake.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import AWKWARD, awkward, empty

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 25 + 75 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, i, doc, -score) for i, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op13_lexical_search"])
    got = QUERIES["op13_lexical_search"](spark, sf_dir)
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == sorted(want.fetchall(), key=str) != []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_equals_a_plain_ranking(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(120)]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.04)), 119)] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 40, 200]))) for i in range(300)]
    copy = text(30)
    docs += [(1000 - i, copy) for i in range(150)] + [(5, copy), (5, copy), (None, copy), (None, None), (7, "T1 t1-T1")]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([0, 1, 5, 30]))) for i in range(25)] + [(99, copy), (99, copy.upper()), (None, "t1"), (100, "nowhere else"), (101, None)]
    if seed == 2:  # many item blocks, spans of items and small blocks of documents
        monkeypatch.setattr(lexical_search, "ITEM_BYTES", 600)
        monkeypatch.setattr(lexical_search, "CELLS", 500)
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
    if seed == 3:  # filters that are nearly full
        monkeypatch.setattr(lexical_search, "BITS", 2)
    got = search(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(items, ITEMS))
    assert rows_of(got) == plain(docs, items)


def test_bounds_are_never_below_scores(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 400)))) for i in range(200)]
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(12))) for i in range(20)]
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    blocks = signature_blocks(df)
    n_docs, n_terms = blocks.selectExpr("sum(docs)", "sum(terms)").first()
    queries = read_items(spark.createDataFrame(items, ITEMS).toArrow())
    queries = weigh(queries, {r.term: r.n for r in document_frequencies(df, queries.terms).collect()}, n_docs, n_terms)
    want = {(i, d): s for i, _, d, s in plain(docs, items, k=10**6)}
    seen, over = 0, []
    for batch in blocks.toArrow().to_batches():
        for row in range(batch.num_rows):
            block = Block(batch, row, queries)
            for lo, bounds in block.bounds():
                for i, item in enumerate(bounds):
                    for doc, bound in zip(block.ids.to_pylist(), item.tolist(), strict=True):
                        score = want.get((queries.ids[lo + i], doc), 0)
                        assert bound >= score
                        seen, over = seen + 1, over + [(bound - score) / max(score, 1)] * (score > 0)
    assert seen == len(docs) * len(items) and np.median(over) < 0.1


def test_levels_and_terms():
    assert levels_of(np.array([1, 2, 3, 4, 5, 8, 9, 16, 17])).tolist() == [1, 2, 3, 3, 4, 4, 5, 5, 6]
    hashes, counts, first, lengths = count_terms(pa.array(["a-B b_b", None, "", "é É 9a\x7f9A", "--"]))
    assert counts.tolist()[:2] in ([1, 3], [3, 1]) and np.diff(first).tolist() == [2, 0, 0, 3, 0] and lengths.tolist() == [4, 0, 0, 4, 0]


def test_awkward_tables(spark):
    items = [(1, "one two"), (2, "w1 w2 w3 x30 long"), (3, "é")]
    table = spark.createDataFrame(items, ITEMS)
    docs = awkward(spark).selectExpr("*", "1 width", "'own' slices", "2 item", "3 rank", "4 id_key", "5 first_key")
    assert rows_of(search(docs, table)) == plain([r[:2] for r in AWKWARD], items)
    assert search(empty(spark), table).count() == 0 and search(docs, table.where("false")).count() == 0
    assert search(docs.where("doc_id = 5"), table).count() == 0
