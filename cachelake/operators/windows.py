"""Newest versions, apply order, packing and per-key sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelake.functions.expressions import role_order
from cachelake.operators.folds import segment_numbers


def newest_per_name(artifacts: DataFrame, prefix: str | None = None) -> DataFrame:
    """The newest artifact of each name (of names with ``prefix``).  Equal
    stamps keep the one listed first (smallest ``id``, a number)."""
    some = artifacts if prefix is None else artifacts.where(F.col("name").startswith(prefix))
    newest = some.groupBy("name").agg(F.max_by(F.struct(*artifacts.columns), F.struct("created_at", -F.col("id"))).alias("_a"))
    return newest.select("_a.*")


def collapse_versions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``path, hash`` of the last line of each path; lines without both parts
    are malformed and dropped."""
    return rows.where("path is not null and hash is not null").groupBy("path").agg(F.max_by("hash", F.struct(*order)).alias("hash")).orderBy("path")


def apply_order(rows: DataFrame, plan: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``path, content_hash, source`` and the columns ``carry``: rows of the
    planned segments applied in total order (rank 0 for the parent first, run,
    role with the driver last, segment); the last write of a path wins."""
    key = F.struct("rank", "run", role_order(F.col("role")).alias("role"), "segment", "content_hash")
    met = rows.join(plan, "segment")
    last = met.groupBy("path").agg(F.max_by(F.struct("content_hash", F.col("segment").alias("source"), *carry), key).alias("v"))
    return last.select("path", "v.content_hash", "v.source", *[f"v.{c}" for c in carry])


def prefix_length_of(items: DataFrame, most: int = 1 << 20, longest: int = 16) -> int:
    """Digits of a prefix under which there are at most ``most`` ids of evenly
    spread hashes, even if all begin with the same digit."""
    n, length = items.count(), 1
    while n > most * 16 ** (length - 1) and length < longest:
        length += 1
    return length


def pack_greedy(items: DataFrame, cap: int, prefix_length: int = 1) -> DataFrame:
    """``items[id, size]`` with ``prefix`` and ``segment_no``: ids in order,
    a segment closing before the item that would exceed ``cap``; an oversize
    item is alone.  Ids are distinct.

    Segments end at prefix boundaries.  A prefix may have any number of ids
    (``operators.folds``); a longer one (``prefix_length_of``) only makes more
    groups.
    """
    return segment_numbers(items, F.substring("id", 1, prefix_length), cap, before=True)


def pack_until_full(items: DataFrame, cap: int, group: str) -> DataFrame:
    """The variant that closes a segment once it has reached ``cap``, so its
    last item may overflow."""
    return segment_numbers(items, F.col(group).cast("string"), cap, before=False)


def chunk(rows: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Request batches of ``n`` rows per holder."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk_no", F.floor((at - 1) / n).cast("int"))


def counter_rate(heartbeats: DataFrame, source: str = "source", order: tuple[str, ...] = ("ts",), value: str = "counter") -> DataFrame:
    """Growth of a cumulative counter since the source's beat before; the
    first beat counts from zero."""
    before = F.lag(value).over(Window.partitionBy(source).orderBy(*order))
    return heartbeats.withColumn("rate", F.col(value) - F.coalesce(before, F.lit(0)))


def counter_rate_per_second(heartbeats: DataFrame, source: str = "source", ts: str = "ts", tie: tuple[str, ...] = (), value: str = "counter") -> DataFrame:
    """``heartbeats`` with ``rate``: a cumulative counter's growth for each
    second since the source's beat before.  Null for the first beat and where
    no time has passed; a counter that fell has begun anew, from zero."""
    order = Window.partitionBy(source).orderBy(ts, *tie)
    before, micros = F.lag(value).over(order), F.unix_micros(F.col(ts).cast("timestamp"))
    grown = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    passed = micros - F.lag(micros).over(order)
    return heartbeats.withColumn("rate", F.when((passed > 0) & before.isNotNull(), grown * 1e6 / passed))


def attempts(dispatches: DataFrame, most: int = 3, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Number each dispatch of a job; a job is given up after ``most``."""
    n = F.row_number().over(Window.partitionBy("job").orderBy(*order))
    return dispatches.withColumn("attempt", n).withColumn("gave_up", F.col("attempt") >= most)


def first_result_wins(completions: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The first completion of each job; its racing duplicates go."""
    n = F.row_number().over(Window.partitionBy("job").orderBy(*order))
    return completions.withColumn("_n", n).where("_n = 1").drop("_n")
