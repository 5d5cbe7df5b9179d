"""Id unions, segment summaries, compaction verdicts and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelake.functions.expressions import digit, epoch_seconds


@dataclass(frozen=True)
class CompactCfg:
    """Compaction thresholds; these are the blob bank's."""

    delta_pct: int = 20
    hysteresis_pct: int = 5
    min_bytes: int = 256 << 20
    max_segments: int = 64


ROW_BANK = CompactCfg(min_bytes=8 << 20, max_segments=32)


def union_ids(*lists: DataFrame) -> DataFrame:
    """The distinct union of id lists, in id order."""
    return reduce(DataFrame.unionByName, [x.select("id") for x in lists]).distinct().orderBy("id")


def union_counts(own: DataFrame, inherited: DataFrame) -> DataFrame:
    """How many ids the own and the inherited lists have, and together."""
    both = own.select("id", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(inherited.select("id", F.lit(0).alias("o"), F.lit(1).alias("i")))
    each = both.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return each.agg(F.sum("o").alias("own"), F.sum("i").alias("inherited"), F.count("*").alias("ids"))


def digest_of(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), ""), 256)


def segment_meta(packed: DataFrame, by: list[str], id_column: str = "id", prefix_digits: int = 1) -> DataFrame:
    """Per segment: blobs, bytes, bitmap of leading digits (``*`` where ids
    are (path, hash) pairs) and a name that its content decides.

    A segment's bytes are capped by packing, so its id list is bounded.
    """
    pairs = F.max(F.col(id_column).contains(" ").cast("int")) == 1
    bitmap = F.array_join(F.array_sort(F.collect_set(digit(id_column))), "")
    return packed.groupBy(*by).agg(
        F.count("*").alias("blobs"), F.sum("bytes").cast("long").alias("bytes"), F.when(pairs, "*").otherwise(bitmap).alias("prefixes"),
        F.concat(F.lit("seg-"), F.substring(digest_of(F.collect_list(F.concat(F.col(id_column), F.lit("\n")))), 1, 16)).alias("name"),
    )


def content_fingerprint(rows: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``group, fp``: a fingerprint of each group's (path, hash) set, whatever
    the order.  ``exclude[path]`` leaves out exact names.

    Paths go through per-prefix fingerprints (by the first two digits of the
    path's hash), so no task has to hold a whole group.
    """
    kept = rows if exclude is None else rows.join(exclude.select("path").distinct(), "path", "left_anti")
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\0"))
    parts = kept.withColumn("_bin", F.substring(F.md5("path"), 1, 2)).groupBy("group", "_bin").agg(digest_of(F.collect_list(line)).alias("_fp"))
    return parts.groupBy("group").agg(digest_of(F.collect_list(F.concat("_bin", F.lit(":"), "_fp"))).alias("fp"))


def table_unchanged(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row ``unchanged``: whether the names are those recorded at seeding."""
    names = index.select(F.lit("all").alias("group"), F.col("id").alias("path"), F.lit("").alias("hash")).distinct()
    now = content_fingerprint(names).select(F.col("fp").alias("_now"))
    return recorded.select("fp").join(now, F.col("fp") == F.col("_now"), "left").agg(F.coalesce(F.max(F.col("_now").isNotNull()), F.lit(False)).alias("unchanged"))


def needs_compaction(segments: DataFrame, cfg: CompactCfg = CompactCfg()) -> DataFrame:
    """``lineage, compact, reason``.  Full packs never count towards the cap
    on segments; hysteresis keeps a bank at the boundary from flapping."""
    full = F.coalesce("full", F.lit(False))
    sums = segments.groupBy("lineage").agg(
        F.sum(F.when(full, F.col("bytes")).otherwise(0)).cast("long").alias("f"), F.sum(F.when(~full, F.col("bytes")).otherwise(0)).cast("long").alias("d"), F.count_if(~full).alias("n"),
    )
    pct = cfg.delta_pct + cfg.hysteresis_pct
    reason = (
        F.when(F.col("n") > cfg.max_segments, "segments")
        .when(F.col("d") < cfg.min_bytes, F.lit(None))
        .when(F.col("f") == 0, "cold-bank")
        .when(F.expr(f"d > (f * {pct}) div 100"), "delta")
    )
    return sums.select("lineage", reason.isNotNull().alias("compact"), reason.alias("reason"))


def compaction_policy(heads: DataFrame, evidence: DataFrame, now: int, cfg: CompactCfg = CompactCfg(), budget: int = 30, rewarm_days: int = 60) -> DataFrame:
    """``lineage, reason`` of the lineages of ``heads`` (their segments):
    thresholds first, then restore time, then age.  A stamp that can't be
    read is never old; no head, no row."""
    verdict = needs_compaction(heads, cfg)
    met = verdict.join(evidence.select("lineage", "delta_restore_secs", "oldest"), "lineage", "left")
    old = F.coalesce(epoch_seconds(F.col("oldest")) < F.lit(now - rewarm_days * 86_400), F.lit(False))
    slow = F.coalesce(F.col("delta_restore_secs") > budget, F.lit(False))
    return met.select("lineage", F.when(F.col("compact"), F.concat(F.lit("thresholds:"), "reason")).when(slow, "restore").when(old, "rewarm").otherwise("none").alias("reason"))


def restore_evidence(fetches: DataFrame, segments: DataFrame) -> DataFrame:
    """Seconds spent on containers that aren't all full packs, and the oldest
    container referenced.  ``fetches[container, secs, created_at]``."""
    full = segments.groupBy("container").agg(F.bool_and(F.coalesce("full", F.lit(False))).alias("all_full"))
    met = fetches.join(full, "container")
    return met.agg(F.sum(F.when(~F.col("all_full"), F.col("secs"))).cast("long").alias("delta_restore_secs"), F.min("created_at").alias("oldest"))


def shed_guard(head_ids: DataFrame, new_ids: DataFrame, distinct: bool = True) -> DataFrame:
    """``lineage, would_shed``: whether a full re-pack has fewer ids than the
    head names.  The row bank counts lines as they are (``distinct=False``)."""
    many = (lambda c: F.count_distinct(c)) if distinct else F.count
    old = head_ids.groupBy("lineage").agg(many("id").alias("o"))
    new = new_ids.groupBy("lineage").agg(many("id").alias("n"))
    return old.join(new, "lineage", "full").select("lineage", (F.coalesce("n", F.lit(0)) < F.coalesce("o", F.lit(0))).alias("would_shed"))


def latency_summary(lookups: DataFrame, points: dict[str, float] | None = None) -> DataFrame:
    """Per verdict ``n`` and nearest-rank percentiles of ``us``, at index
    round((n - 1) p), halves away from zero.

    Counts per distinct value are accumulated instead of sorting all rows.
    """
    points = points or {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 0.99999}
    counts = lookups.groupBy("verdict", "us").agg(F.count("*").alias("c"))
    run = counts.withColumn("cum", F.sum("c").over(Window.partitionBy("verdict").orderBy("us"))).withColumn("n", F.sum("c").over(Window.partitionBy("verdict")))
    at = {name: F.min(F.when(F.col("cum") >= F.round((F.col("n") - 1) * F.lit(p)) + 1, F.col("us"))).alias(name) for name, p in points.items()}
    return run.groupBy("verdict").agg(F.max("n").alias("n"), *at.values())


def queue_summary(jobs: DataFrame, limit_s: int = 120) -> DataFrame:
    """Per platform of ``jobs[os, arch, job, age_s]``: queued, oldest age,
    whether it starves, and which job is the oldest if so."""
    oldest = F.max(F.struct("age_s", (-F.col("job")).alias("j")))
    got = jobs.groupBy(F.when(F.col("os") == "", "*").otherwise(F.col("os")).alias("os"), F.when(F.col("arch") == "", "*").otherwise(F.col("arch")).alias("arch")).agg(F.count("*").alias("queued"), oldest.alias("o"))
    starved = F.col("o.age_s") > limit_s
    return got.select("os", "arch", "queued", F.col("o.age_s").alias("oldest_s"), starved.alias("starved"), F.when(starved, -F.col("o.j")).alias("job"))


def dispatch_counts(events: DataFrame) -> DataFrame:
    """Jobs per worker, and in all (worker ``*``)."""
    each = events.groupBy(F.col("worker").cast("string").alias("worker")).agg(F.count("*").alias("jobs"))
    return each.unionByName(each.agg(F.lit("*").alias("worker"), F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs")))


def cache_report(lookups: DataFrame, seeded: int) -> DataFrame:
    """Hits, misses, unservable, bytes, ok and failed hits, and a tripwire: a
    seeded cache without a hit is broken."""
    hit = F.col("verdict") == "HIT"
    got = lookups.agg(
        F.count_if(hit).alias("hits"), F.count_if(F.col("verdict") == "MISS").alias("misses"), F.count_if(F.col("verdict") == "UNSERVABLE").alias("unservable"),
        F.coalesce(F.sum(F.when(hit, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(hit & (F.col("exit_code") == 0)).alias("hit_ok"), F.count_if(hit & (F.col("exit_code") != 0)).alias("hit_failed"),
    )
    return got.withColumn("tripwire", (F.lit(seeded) > 0) & (F.col("hits") == 0) & (F.col("misses") > 0))


def fetch_sources(fetches: DataFrame) -> DataFrame:
    """Per worker: how many fetches were local, from peers, from the driver."""
    names = ["local", "peer", "driver"]
    got = fetches.groupBy("worker").agg(*[F.count_if(F.col("source") == s).alias(s) for s in names])
    return got.select("worker", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in names])).alias("x")).select("worker", "x.*")


def off_node_bytes(placements: DataFrame, inputs: DataFrame, holdings: DataFrame, workers: int) -> DataFrame:
    """Bytes moved since jobs ran where their inputs aren't, against
    total (1 - 1/workers) without locality; over half of that regresses."""
    placed = inputs.join(placements, "action")
    moved = placed.join(holdings.select("peer", "hash").distinct(), ["peer", "hash"], "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("moved"))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    both = moved.crossJoin(total)  # two one-row tables
    base = (F.col("total") * (workers - 1)) / F.lit(workers)
    return both.select(F.col("moved").cast("long").alias("moved"), F.col("total").cast("long").alias("total"), F.floor(base).cast("long").alias("baseline"), (F.col("moved") * 2 > base).alias("regressed"))


def quorum(joins: DataFrame, min_workers: int, require_shards: int) -> DataFrame:
    """Distinct workers and preloaded shards against what is required."""
    got = joins.agg(F.count_distinct("worker").alias("workers"), F.count_distinct("shard").alias("shards"))
    return got.withColumn("formed", (F.col("workers") >= min_workers) & (F.col("shards") >= require_shards))
