"""Predicates over blobs, result rows and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.functions.expressions import digit, owned_digits

HOT_BYTES = 256 * 1024


def verify_digests(blobs: DataFrame) -> DataFrame:
    """``name, ok``: whether the content of ``blobs[name, content]`` has the
    hash that it is named by."""
    return blobs.select("name", F.coalesce(F.sha2("content", 256) == F.lower("name"), F.lit(False)).alias("ok"))


def verify_counts(blobs: DataFrame) -> DataFrame:
    return verify_digests(blobs).agg(F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("rejected"))


def check_expected(uploads: DataFrame) -> DataFrame:
    """``uploads[exp_hash, exp_size, content]`` with ``accepted``: hash AND
    size have to agree."""
    same = (F.sha2("content", 256) == F.lower("exp_hash")) & (F.octet_length("content") == F.col("exp_size"))
    return uploads.withColumn("accepted", F.coalesce(same, F.lit(False))).drop("content")


def purge_failures(rows: DataFrame) -> DataFrame:
    """Rows that didn't fail; a row whose code can't be read stays."""
    return rows.where(F.col("exit_code").isNull() | (F.col("exit_code") == 0))


def purge_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("exit_code") != 0).alias("purged"))


def cacheable_only(rows: DataFrame, cache_failures: bool = False) -> DataFrame:
    """Rows that may be cached.  ``persisted`` marks the strict subset that
    outlives the session: success only."""
    allowed = ~F.coalesce("do_not_cache", F.lit(False)) & ((F.col("exit_code") == 0) | F.lit(cache_failures))
    return rows.where(allowed).withColumn("persisted", F.col("exit_code") == 0)


def provenance_filter(artifacts: DataFrame, lineage: str) -> DataFrame:
    """Artifacts that may be trusted for ``lineage``; ``-`` takes any live one."""
    live = ~F.coalesce("expired", F.lit(False))
    if lineage == "-":
        return artifacts.where(live)
    return artifacts.where(live & F.col("head_branch").eqNullSafe(lineage) & F.coalesce("same_repo", F.lit(False)))


def in_range(rows: DataFrame, shard: int, of: int = 8, column: str = "hash") -> DataFrame:
    """Rows in the shard's range of leading hex digits."""
    return rows.where(digit(column).isin(owned_digits(shard, of)))


def hot_set(candidates: DataFrame, held: DataFrame, max_bytes: int = HOT_BYTES) -> DataFrame:
    """Small non-empty blobs that aren't held yet."""
    small = candidates.where((F.col("bytes") > 0) & (F.col("bytes") <= max_bytes))
    return small.join(held.select("hash").distinct(), "hash", "left_anti")
