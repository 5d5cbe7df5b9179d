"""Hash trees: roots that partitioning doesn't change, differences by descent."""

import hashlib
import random

import pytest

from cachelake.operators import trees as tr

SCHEMA = "group string, path string, hash string"


def sha(parts):
    return hashlib.sha256("".join(sorted(parts)).encode()).hexdigest()


def plain(lines, depth, prefix=""):
    """Digests of all nodes of a set's tree."""
    if len(prefix) == depth:
        return {prefix: sha(lines)}
    out, children = {}, []
    for d in "0123456789abcdef":
        own = [x for x in lines if hashlib.md5(x.encode()).hexdigest().startswith(prefix + d)]
        if own:
            below = plain(own, depth, prefix + d)
            children.append(f"{d}:{below[prefix + d]}")
            out |= below
    return out | {prefix: sha(children)}


def test_nodes_are_those_of_a_plain_tree(spark):
    rng = random.Random(2)
    rows = [(g, f"p{i}", f"h{rng.randrange(9)}") for g, n in (("big", 700), ("mid", 40), ("leaf", 8), (None, 3)) for i in range(n)]
    df = spark.createDataFrame([*rows, *rows[:50]], SCHEMA)
    nodes = tr.hash_tree(df.repartition(5), 16).collect()
    for group, depth in (("big", 2), ("mid", 1), ("leaf", 0), (None, 0)):
        own = [r for r in nodes if r.group == group]
        assert {r.prefix: r.digest for r in own} == plain([f"{p}\0{h}\0" for g, p, h in rows if g == group], depth)
        assert all(r.depth == len(r.prefix) for r in own) and max(r.n for r in own if r.depth == depth) <= 16
        assert next(r.n for r in own if r.depth == 0) == sum(g == group for g, _, _ in rows)
    again = tr.roots(tr.hash_tree(df.repartition(1), 16)).collect()
    assert {(r.group, r.fp) for r in again} == {(r.group, r.digest) for r in nodes if r.depth == 0}
    assert tr.hash_tree(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_differences(spark, seed):
    rng = random.Random(seed)
    a = {(g, f"p{i}", f"h{rng.randrange(3)}") for g, n in (("big", 600), ("small", 5), ("same", 100)) for i in range(n)}
    b = {r for r in a if r[0] == "same" or rng.random() > 0.03} | {("big", f"new{i}", "h") for i in range(20)} | {("other", "x", "y"), (None, "x", "y")}
    da, db = (spark.createDataFrame(sorted(x, key=str), SCHEMA) for x in (a, b))
    got = {tuple(r) for r in tr.set_difference(da, db, 16).collect()}
    assert got == {(*r, "before") for r in a - b} | {(*r, "after") for r in b - a}
    assert tr.set_difference(da, da, 16).count() == 0


def test_descent_visits_only_what_differs(spark):
    a = spark.createDataFrame([("g", f"p{i}", "h") for i in range(2000)], SCHEMA)
    b = a.where("path <> 'p77'")
    depths = tr.common_depths(a, b, 16)
    leaves = tr.differing_leaves(tr.hash_tree(a, 16, depths), tr.hash_tree(b, 16, depths)).collect()
    assert [(r.group, r.prefix) for r in leaves] == [("g", hashlib.md5(b"p77\0h\0").hexdigest()[:3])]


def test_an_index_is_known_again_by_its_root(spark):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(3000)], "id string")
    recorded = tr.roots(tr.hash_tree(tr.id_set(ids)))
    none = spark.createDataFrame([], "id string")
    assert tr.index_unchanged(ids.union(ids.limit(9)).repartition(7), recorded).first().unchanged
    assert not tr.index_unchanged(ids.where("id <> 'p5'"), recorded).first().unchanged and not tr.index_unchanged(none, recorded).first().unchanged
    assert tr.index_unchanged(none, recorded.where("false")).first().unchanged
