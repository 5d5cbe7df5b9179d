"""Hash trees over sets of (path, hash) pairs.

A pair's line is placed by its MD5; a leaf digests the sorted lines under a
prefix of that, an inner node its at most 16 children.  A group's depth follows
its number of pairs, so a leaf has a quarter of ``leaf_rows`` lines on average
and, places being evenly spread, practically never more than ``leaf_rows``.
Equal sets have equal roots, however they are partitioned; two trees of one
depth differ only on the way to leaves whose lines differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelake.operators.aggregates import digest_of
from cachelake.sources.storage import scratch_path

LEAF_ROWS = 1024
MOST_DEPTH = 12


def depth_of(n: Column, leaf_rows: int = LEAF_ROWS) -> Column:
    """Digits of a leaf's prefix in a tree of ``n`` lines."""
    depth = F.lit(MOST_DEPTH)
    for d in range(MOST_DEPTH - 1, 0, -1):
        depth = F.when(n <= leaf_rows // 4 * 16**d, d).otherwise(depth)
    return F.when(n <= leaf_rows, 0).otherwise(depth)


def _lines(rows: DataFrame) -> DataFrame:
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\0"))
    return rows.select("group", line.alias("line")).distinct().withColumn("place", F.md5("line"))


def _depths(lines: DataFrame, leaf_rows: int) -> DataFrame:
    """The depths of groups that don't fit into one leaf."""
    counts = lines.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows)
    return counts.select("group", depth_of(F.col("n"), leaf_rows).alias("depth"))


def _placed(lines: DataFrame, depths: DataFrame) -> DataFrame:
    """``lines`` with the ``prefix`` of their leaf."""
    deep = depths.select(F.col("group").alias("_group"), "depth")
    met = lines.join(deep, F.col("group").eqNullSafe(F.col("_group")), "left")
    return met.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("prefix", F.expr("substring(place, 1, depth)")).drop("_group")


def hash_tree(rows: DataFrame, leaf_rows: int = LEAF_ROWS, depths: DataFrame | None = None) -> DataFrame:
    """``group, depth, prefix, n, digest``: all nodes of each group's tree of
    ``rows[group, path, hash]``; a root's prefix is empty.  ``depths`` may set
    groups' depths, so that two sets can be compared.

    Lines move once to count a group (as counts) and once to their leaves; only
    digests move further up, a written table for each level.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "tree")
    lines = _lines(rows)
    depths = _depths(lines, leaf_rows) if depths is None else depths
    schema = "group " + rows.schema["group"].dataType.simpleString() + ", depth int, prefix string, n long, digest string"
    leaves = _placed(lines, depths).groupBy("group", "depth", "prefix").agg(F.count("*").alias("n"), digest_of(F.collect_list("line")).alias("digest"))
    leaves.write.parquet(f"{path}/leaves")
    leaves = spark.read.schema(schema).parquet(f"{path}/leaves")
    top = leaves.agg(F.max("depth")).first()[0] or 0  # one number
    parts, below = [leaves], leaves.where(F.col("depth") == top)
    for depth in range(top - 1, -1, -1):
        child = F.concat(F.substring("prefix", -1, 1), F.lit(":"), "digest")
        up = below.groupBy("group", F.expr(f"substring(prefix, 1, {depth})").alias("prefix")).agg(F.sum("n").alias("n"), digest_of(F.collect_list(child)).alias("digest"))
        up.select("group", F.lit(depth).alias("depth"), "prefix", "n", "digest").write.parquet(f"{path}/level={depth}")
        up = spark.read.schema(schema).parquet(f"{path}/level={depth}")
        parts.append(up)
        below = up.unionByName(leaves.where(F.col("depth") == depth))
    tree = parts[0]
    for more in parts[1:]:
        tree = tree.unionByName(more)
    return tree


def roots(tree: DataFrame) -> DataFrame:
    """``group, fp``: a fingerprint of each group's set."""
    return tree.where("depth = 0").select("group", F.col("digest").alias("fp"))


def common_depths(a: DataFrame, b: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Depths at which the trees of two sets can be compared: the larger's."""
    both = _depths(_lines(a), leaf_rows).unionByName(_depths(_lines(b), leaf_rows))
    return both.groupBy("group").agg(F.max("depth").alias("depth"))


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """``group, prefix``: leaves that two trees of the same depths have
    differently, or only one has.

    Level by level, children are only looked at where their parents differ, so
    where sets are alike no more than their upper nodes is read.
    """
    spark, path = a.sparkSession, scratch_path(a.sparkSession, "differing")
    top = max((x.agg(F.max("depth")).first()[0] or 0) for x in (a, b))  # two numbers
    found: list[DataFrame] = []
    for depth in range(top + 1):
        sides = [x.where(F.col("depth") == depth).select("group", "prefix", F.col("digest").alias(name)) for x, name in ((a, "da"), (b, "db"))]
        if found:
            parents = found[-1].select(F.col("group").alias("_group"), F.col("prefix").alias("_parent"))
            met = F.col("group").eqNullSafe(F.col("_group")) & (F.expr(f"substring(prefix, 1, {depth - 1})") == F.col("_parent"))
            sides = [s.join(parents, met, "left_semi") for s in sides]
        each = sides[0].select("group", "prefix", "da", F.lit(None).cast("string").alias("db")).unionByName(sides[1].select("group", "prefix", F.lit(None).cast("string").alias("da"), "db"))
        pairs = each.groupBy("group", "prefix").agg(F.max("da").alias("da"), F.max("db").alias("db"))
        pairs.where(~F.col("da").eqNullSafe(F.col("db"))).select("group", "prefix").write.parquet(f"{path}/{depth}")
        found.append(spark.read.parquet(f"{path}/{depth}"))
    leaves = []
    for depth, level in enumerate(found):
        if depth == top:
            leaves.append(level)
        else:  # a prefix that none goes on from is a leaf
            below = found[depth + 1].select(F.col("group").alias("_group"), F.expr(f"substring(prefix, 1, {depth})").alias("_parent")).distinct()
            leaves.append(level.join(below, F.col("group").eqNullSafe(F.col("_group")) & (F.col("prefix") == F.col("_parent")), "left_anti"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def set_difference(a: DataFrame, b: DataFrame, leaf_rows: int = LEAF_ROWS, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``group, path, hash, side``: the pairs that only ``a`` (``before``) or
    only ``b`` (``after``) has.

    Only pairs in leaves that differ are compared.  ``trees`` may have both
    sides' ``hash_tree`` at ``common_depths``, kept from before.
    """
    depths = common_depths(a, b, leaf_rows)
    ta, tb = trees or (hash_tree(a, leaf_rows, depths), hash_tree(b, leaf_rows, depths))
    leaves = differing_leaves(ta, tb).select(F.col("group").alias("_group"), F.col("prefix").alias("_prefix"))
    met = F.col("group").eqNullSafe(F.col("_group")) & (F.col("prefix") == F.col("_prefix"))
    some = [_placed(_lines(x), depths).join(leaves, met, "left_semi").select("group", "line", F.lit(s).alias("side")) for x, s in ((a, 1), (b, 2))]
    alone = some[0].unionByName(some[1]).groupBy("group", "line").agg(F.sum("side").alias("side")).where("side < 3")
    parts = F.split("line", "\0")
    return alone.select("group", parts[0].alias("path"), parts[1].alias("hash"), F.when(F.col("side") == 1, "before").otherwise("after").alias("side"))


def id_set(ids: DataFrame) -> DataFrame:
    """A list of ids as one group's set."""
    return ids.select(F.lit("all").alias("group"), F.col("id").alias("path"), F.lit("").alias("hash"))


def index_unchanged(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row ``unchanged``: whether the distinct ids of ``index`` are those
    whose root ``recorded[fp]`` has.  An empty index is unchanged only if
    nothing is recorded, since an empty set has no tree."""
    now = roots(hash_tree(id_set(index))).select(F.col("fp").alias("now"))
    both = recorded.select("fp").agg(F.max("fp").alias("fp")).crossJoin(now.agg(F.max("now").alias("now")))  # one-row tables
    return both.select(F.col("fp").eqNullSafe(F.col("now")).alias("unchanged"))
