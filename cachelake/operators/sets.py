"""Limits and set operations over ranges and fleets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.functions.expressions import digit, owned_digits
from cachelake.operators.filters import in_range


def recent_spills(spills: DataFrame, rows: DataFrame, cutoff: object, shard: int, of: int = 8, most: int = 40) -> DataFrame:
    """Own-range rows of the newest ``most`` spills after ``cutoff`` (null:
    all).  The limit is the feature: older spills are compacted already."""
    later = spills if cutoff is None else spills.where(F.col("created_at") > F.lit(cutoff))
    newest = later.orderBy(F.desc("created_at"), "spill").limit(most)
    return in_range(rows.join(newest.select("spill"), "spill", "left_semi"), shard, of)


def sample_unservable(verdicts: DataFrame, missing: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` unservable keys, in order, with their first missing
    reference, for a report."""
    first = missing.groupBy("action").agg(F.min("hash").alias("first_missing"))
    dead = verdicts.where("verdict = 'UNSERVABLE'").select("key").distinct()
    return dead.join(first, F.col("key") == F.col("action")).select("key", "first_missing").orderBy("key").limit(most)


def fleet_union(holdings: DataFrame, shard: int, of: int = 8) -> DataFrame:
    """``hash, size`` of what any peer has in a range.  A silent peer is just
    absent; of different sizes the smallest counts."""
    return in_range(holdings, shard, of).groupBy("hash").agg(F.min("size").alias("size"))


def sync_gap(fleet: DataFrame, own: DataFrame) -> DataFrame:
    """What one owner lacks of its range's fleet union."""
    return fleet.join(own.select("hash").distinct(), "hash", "left_anti")


def split_range(delta: DataFrame, shard: int, state_known: bool = True, of: int = 8) -> DataFrame:
    """``delta`` with ``dest``: ``bank`` for the own range, ``spill`` for the
    rest, and for all if the own state is unknown."""
    own = digit("hash").isin(owned_digits(shard, of)) & F.lit(state_known)
    return delta.withColumn("dest", F.when(own, "bank").otherwise("spill"))


def same_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """The ids, with ``side``, that only one of two lists has."""
    lost = before.select("id").exceptAll(after.select("id")).withColumn("side", F.lit("before"))
    return lost.unionByName(after.select("id").exceptAll(before.select("id")).withColumn("side", F.lit("after")))
