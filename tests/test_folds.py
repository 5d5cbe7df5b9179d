"""Packing by pieces against a plain walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachelake.operators.folds import BEGIN, Piece, segment_numbers
from cachelake.operators.windows import pack_greedy, pack_until_full


def walk(sizes, cap, before):
    out, acc, n = [], 0, -1
    for s in sizes:
        if n < 0 or (acc + s > cap if before else acc >= cap):
            n, acc = n + 1, 0
        acc += s
        out.append(n)
    return out


@pytest.mark.parametrize("before", [True, False])
def test_steps_and_numbers_of_pieces(before):
    rng = random.Random(before)
    for _ in range(400):
        sizes = [rng.choice([0, 1, 2, 3, 7, 20]) for _ in range(rng.randrange(1, 60))]
        cap = rng.choice([1, 5, 10, 30, 500])
        cuts = sorted({0, len(sizes), *(rng.randrange(len(sizes)) for _ in range(4))})
        got, carry, starts = [], BEGIN, 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            piece = Piece(np.array(sizes[lo:hi]), cap, before)
            got += piece.numbers(carry, starts).tolist()
            steps = piece.steps()
            assert [s[0] for s in steps] == sorted({s[0] for s in steps})
            least, n, out = max(s for s in steps if s[0] <= carry)
            carry, starts = (out if n else carry + out), starts + n
        assert got == walk(sizes, cap, before)


def test_few_steps_for_many_items():
    rng = np.random.default_rng(1)
    piece = Piece(rng.integers(1, 2000, 200_000), 100_000, True)
    assert len(piece.steps()) < 60


@pytest.mark.parametrize("rows", [7, 50, 1 << 18])
def test_one_group_over_many_tasks(spark, rows):
    rng = random.Random(5)
    items = [(f"{rng.randrange(16**8):08x}", rng.randrange(1, 300), None if i % 9 == 0 else bytes([i % 256])) for i in range(400)]
    df = spark.createDataFrame(items, "id string, size long, more binary").repartition(5)
    for before in (True, False):
        got = segment_numbers(df.withColumn("g", F.when(F.col("id") < "c", "one")), F.col("g"), 1000, before, rows)
        assert got.columns == ["id", "size", "more", "g", "prefix", "segment_no"]
        found = {r.id: (r.prefix, r.segment_no, r.more and bytes(r.more)) for r in got.collect()}
        for g in ("one", None):
            own = sorted(i for i in items if (i[0] < "c") == (g == "one"))
            assert [found[i[0]] for i in own] == [(g, n, i[2]) for i, n in zip(own, walk([i[1] for i in own], 1000, before), strict=True)]


def test_packers_use_it(spark):
    items = spark.createDataFrame([("a1", 6), ("a2", 6), ("b1", 30), ("b2", 1)], "id string, size long").withColumn("shard", F.lit(3))
    assert sorted(r.id + r.prefix + str(r.segment_no) for r in pack_greedy(items, 10).collect()) == ["a1a0", "a2a1", "b1b0", "b2b1"]
    assert sorted(r.id + str(r.segment_no) for r in pack_until_full(items, 10, "shard").collect()) == ["a10", "a20", "b11", "b22"]
    assert pack_greedy(items.where("false"), 10).count() == 0
