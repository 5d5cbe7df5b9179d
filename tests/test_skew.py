"""Hot keys: found by a bounded sketch, their pairs spread, none lost."""

import random
import re

from pyspark.sql import functions as F

from cachelake.functions.expressions import bloom_positions
from cachelake.operators import joins as jn
from cachelake.operators import windows as wn


def test_heavy_keys_are_found(spark):
    rows = [("hot",)] * 900 + [("warm",)] * 60 + [(None,)] * 500 + [(f"k{i}",) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string").repartition(4)
    assert {r.k for r in jn.heavy_keys(df, "k", 0.1).collect()} == {"hot"}
    assert {r.k for r in jn.heavy_keys(df, "k", 0.01).collect()} == {"hot", "warm"}
    assert jn.heavy_keys(df.where("false"), "k").count() == 0


def test_salted_join_makes_each_pair_once_and_spreads_the_hot(spark):
    rng = random.Random(2)
    left = [(i, "hot" if i % 2 else rng.choice("abc")) for i in range(60)] + [(99, None)]
    right = [("hot" if i % 3 else rng.choice("abc"), i) for i in range(90)] + [(None, 99)]
    a, b = spark.createDataFrame(left, "root long, k string"), spark.createDataFrame(right, "k string, peer long")
    heavy = spark.createDataFrame([("hot",)], "k string")
    got = jn.join_salted(a, b, "k", heavy, ["peer"], 8)
    want = sorted((r, k, p) for r, k in left for k2, p in right if k is not None and k == k2)
    assert sorted((r.root, r.k, r.peer) for r in got.collect()) == want
    assert sorted((r.root, r.k, r.peer) for r in jn.join_salted(a, b, "k", heavy.where("false"), ["peer"]).collect()) == want
    # No task of the hot key's pairs has most of them.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = [r["count"] for r in jn.join_salted(a, b, "k", heavy, ["peer"], 8).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(spread) > 2 and max(spread) < 0.7 * sum(spread)


def test_claims_of_more_than_sixty_four_peers(spark):
    rng, nbits = random.Random(3), 1024
    names = [f"{rng.randrange(16**64):064x}" for _ in range(40)] + ["0" * 64]
    held = [(f"p{i:03d}", h) for i in range(150) for h in rng.sample(names, 5)]
    blooms = jn.bloom_build(spark.createDataFrame(held, "owner string, hash string"), nbits)
    asked = spark.createDataFrame([(h,) for h in names], "hash string")
    bits = {r.hash: set(r.b) for r in asked.select("hash", bloom_positions("hash", nbits).alias("b")).collect()}
    summary = {}
    for p, h in held:
        summary.setdefault(p, set()).update(bits[h])
    want = sorted((h, p) for h in names for p, s in summary.items() if bits[h] <= s)
    assert sorted((r.hash, r.peer) for r in jn.claims(asked, blooms, nbits).collect()) == want
    assert {(h, p) for p, h in held} <= set(want)


def test_rates_by_the_time_between_beats(spark):
    rows = [("a", 0, 1, 100), ("a", 60, 2, 400), ("a", 60, 3, 500), ("a", 61, 4, 50), ("b", 5, 5, 7)]
    df = spark.createDataFrame(rows, "source string, s long, n int, counter long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.n: r.rate for r in wn.counter_rate_per_second(df, tie=("n",)).collect()}
    assert got == {1: None, 2: 5.0, 3: None, 4: 50.0, 5: None}


def test_locality_shuffles_lists_of_holders_not_pairs(spark):
    """Files with more holders than a list has, ties and a file of no size."""
    from cachelake.operators import joins as jn

    inputs = [(r, f"h{(r * 7 + i) % 40}", (r + i) % 5) for r in range(30) for i in range(10)]
    holdings = [(p, f"h{h}") for h in range(38) for p in range(1200 if h == 3 else 5 + h) if (p + h) % 3]
    df = jn.locality_pref(spark.createDataFrame(inputs, "root long, hash string, size long"), spark.createDataFrame(holdings, "peer long, hash string"))
    want = {}
    for root in range(30):
        scores = {}
        for _, h, size in sorted((x for x in inputs if x[0] == root), key=lambda x: (-x[2], x[1]))[:8]:
            for p, held in holdings:
                if held == h:
                    scores[p] = scores.get(p, 0) + size
        best = min(((-s, p) for p, s in scores.items() if s > 0), default=None)
        if best:
            want[root] = (best[1], -best[0])
    assert {r.root: (r.peer, r.score) for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(root#\d+L?, peer#", plan)
